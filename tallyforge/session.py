"""Sessions, table registration and schema revisions."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


#: A recursive query's rows grow with its tables, so Spark's limit of a million does not hold; that of its levels does.
RECURSION_ROWS = ("spark.sql.cteRecursionRowLimit", "-1")


def build_session(app: str = "tallyforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master) if master else builder
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.runSQLOnFiles": "false", RECURSION_ROWS[0]: RECURSION_ROWS[1]}
    return builder.config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, by spark.checkpoint.dir; a local session may go without and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tallyforge-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def cut_lineage(x: DataFrame) -> DataFrame:
    """``x`` written to the shared folder as a checkpoint, which lost executors do not take with them."""
    context = x.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(x.sparkSession))
    return x.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views for tables, so SQL texts can name them."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def schema_revision(df: DataFrame) -> str:
    """A hash of a DataFrame's schema; a changed table has another one."""
    return hashlib.sha256(df.schema.json().encode()).hexdigest()


class SchemaChanged(RuntimeError):
    """A table's schema is not what it was when it was captured."""


def require_revision(df: DataFrame, captured: str) -> DataFrame:
    """``df`` if its schema still has the captured revision."""
    if schema_revision(df) != captured:
        raise SchemaChanged("the schema changed since it was captured")
    return df


class SchemaCache:
    """What a loader tells of named tables, held for a lifetime; many that ask at once share one load.

    An entry belongs to a source, a name and a revision, so a table whose schema changed is loaded again at once,
    whatever the age of its entry. A load that fails is not held, and all that waited for it get its error. Beyond
    ``most`` entries the one that nobody asked for the longest goes.
    """

    def __init__(self, seconds: float = 300.0, most: int = 10_000, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock = seconds, most, clock
        self._held: OrderedDict[tuple[str, str], tuple[str, float, Future]] = OrderedDict()
        self._lock = threading.Lock()

    def get(self, source: str, name: str, revision: str, load: Callable[[], object]) -> object:
        """``load()``, or what it gave within the lifetime for the same revision."""
        key = (source, name)
        with self._lock:
            now, seen = self.clock(), self._held.get(key)
            fresh = seen is not None and seen[0] == revision and now - seen[1] < self.seconds
            found = seen[2] if fresh else Future()
            if not fresh:
                self._held[key] = (revision, now, found)
            self._held.move_to_end(key)
            while len(self._held) > self.most:
                self._held.popitem(last=False)
        if not fresh:
            try:
                found.set_result(load())
            except BaseException as e:
                with self._lock:
                    if key in self._held and self._held[key][2] is found:
                        del self._held[key]
                found.set_exception(e)
        return found.result()

    def drop(self, source: str, name: str | None = None) -> None:
        """Forget a table, or all tables of a source."""
        with self._lock:
            for key in [k for k in self._held if k[0] == source and name in (None, k[1])]:
                del self._held[key]

    def __len__(self) -> int:
        return len(self._held)
