"""Session construction and the tables by which long plans are cut.

Intermediate results are written as Parquet below ``spark.checkpoint.dir``, a folder that all
executors share, so a lost executor never takes the only copy of a stage with it.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which :func:`small` lets a side be broadcast. Larger sides take the shuffle join.
BROADCAST_BYTES = 8 << 20

_shipping = threading.Lock()
_written: list[tuple[SparkSession, str]] = []


def build_session(app: str = "corpuslane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume (UTC, AQE); ``conf`` overrides them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once per context, wherever they run."""
    sc = spark.sparkContext
    with _shipping:  # queries may be built in several threads
        if getattr(sc, "_corpuslane_shipped", False):
            return
        here = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="corpuslane-")) / "corpuslane_code.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        sc.addPyFile(str(path))
        sc._corpuslane_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes in fewer partitions than there are, as small single files do; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    with _shipping:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="corpuslane-")
            spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        _delete(spark, path)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once below the scratch root and return a scan of it; this cuts the lineage."""
    spark = df.sparkSession
    ship(spark)
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*dfs: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_scratch", None)
        if path:
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def release_all(spark: SparkSession) -> None:
    """Delete all tables that :func:`materialize` wrote in this session; results that still read them are lost."""
    for s, path in list(_written):
        if s is spark:
            _delete(spark, path)
    _written[:] = [x for x in _written if x[0] is not spark]


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows times ``row_bytes`` fit ``limit``, else as it is.

    ``df`` should be cheap to count, e.g. come from :func:`materialize`.
    """
    n = df.limit(limit // row_bytes + 1).count()
    return F.broadcast(df) if n * row_bytes <= limit else df
