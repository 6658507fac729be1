"""Tables of iterative operators, kept where a lost executor does not matter."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint.

    The cluster's ``spark.checkpoint.dir`` is used as it is; only a local
    session without one gets a temporary folder. A checkpoint alone keeps the
    size and constraints that were estimated for its plan. A join's estimate is
    the product of its sides', so in a loop that joins a table with itself the
    number of its digits doubles each round until it fills the driver.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not (context.master or "").startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="codelattice-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    done = df.checkpoint()
    session = df.sparkSession
    plain = session._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    return DataFrame(plain, session)
