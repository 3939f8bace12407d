"""References to records that do not exist: pending-orphan state, kept incrementally (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import fresh_path
from tidemark.sources.tables import broadcast_if_small

REFERENCES = "link string, key string, src_table string, row_id bigint, at_us bigint"
PARENTS = "parent_id string, link string, key string, from_us bigint"
SPREAD = "l string, k string, from_us bigint, until_us bigint, s bigint"
SETTLED = REFERENCES + ", settled int"
REOPENED = "src_table string, row_id bigint, reopened int"
DELETIONS = "parent_id string, link string, key string, until_us bigint"
#: References and parents meet within spans of this length, so that a hot key is split along time.
SPAN_US = 30 * 86_400_000_000


def _span(c: str | Column) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(SPAN_US))


class OrphanLedger:
    """Keyed state of references and the parents they wait for, in tables of the shared folder.

    ``apply`` takes what has newly arrived, in any order and any grouping: new references probe the parent index,
    arriving parents resolve waiting orphans, deletions reopen settled references that nothing else supports.
    ``waiting()`` holds the orphans as of the last batch. A reference at time t is supported by a parent of the same
    link and key with from <= t < until (no until: still there). Parents are rows identified by ``parent_id``, a text
    or number of the caller's (their own columns, not a hash, where they have no key);
    loading or deleting one again changes nothing, of several deletions the earliest counts. References without key
    or time are left out; those delivered twice stay two rows.

    Each batch writes the references it settles, those it reopens, and the waiting ones, which is the only table
    written anew each time (small where most references are sound). State of a batch is only read after its
    tables are complete, so a lost executor costs a retry and nothing else. All joins are equi-joins on link, key
    and time span, in the JVM; a hot key is spread over spans, and within one over tasks by adaptive execution.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.epoch = spark, fresh_path(spark, "orphans"), 0

    def _read(self, name: str, schema: str, epochs: range) -> DataFrame:
        paths = [f"{self.root}/{name}/{e}" for e in epochs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def waiting(self) -> DataFrame:
        """The orphans after the last batch: (link, key, src_table, row_id, at_us)."""
        return self._read("waiting", REFERENCES, range(self.epoch - 1, self.epoch) if self.epoch else range(0))

    def snapshots(self) -> DataFrame:
        """Counts of waiting references after every batch: (epoch, src_table, period, orphans)."""
        return self._read("snapshots", "epoch int, src_table string, period string, orphans bigint", range(self.epoch))

    def _index(self, parents: DataFrame, deletions: DataFrame) -> DataFrame:
        gone = deletions.groupBy("parent_id").agg(F.min("until_us").alias("until_us"))
        live = parents.dropDuplicates(["parent_id"]).join(gone, "parent_id", "left")
        # whatever a key's parents are, only their union matters: equal starts keep the furthest end
        return live.groupBy("link", "key", "from_us").agg(
            F.max(F.coalesce("until_us", F.lit(2**62))).alias("until_us")
        ).where("until_us > from_us")

    @staticmethod
    def _spread(index: DataFrame, horizon: int) -> DataFrame:
        """The index with a row for each time span that a parent reaches into, up to the last reference."""
        last = F.least(F.col("until_us") - 1, F.lit(horizon))
        return index.where(F.col("from_us") <= horizon).select(
            F.col("link").alias("l"), F.col("key").alias("k"), "from_us", "until_us",
            F.explode(F.sequence(_span("from_us"), F.greatest(_span(last), _span("from_us")))).alias("s"),
        )

    def _held_index(self, name: str, index: DataFrame, horizon: int) -> DataFrame:
        """The spread index, written once for all probes of this batch; broadcast only if it is counted to be small."""
        path = f"{self.root}/{name}/{self.epoch}"
        self._spread(index, horizon).write.parquet(path)
        return broadcast_if_small(self.spark.read.schema(SPREAD).parquet(path))

    @staticmethod
    def _probe(refs: DataFrame, spread: DataFrame, how: str) -> DataFrame:
        on = (
            (F.col("link") == F.col("l")) & (F.col("key") == F.col("k")) & (_span("at_us") == F.col("s"))
            & (F.col("from_us") <= F.col("at_us")) & (F.col("at_us") < F.col("until_us"))
        )
        return refs.join(spread, on, how)

    def apply(self, references: DataFrame, parents: DataFrame, deletions: DataFrame) -> None:
        """Take in one batch. The columns are those of ``REFERENCES``, ``PARENTS`` and ``DELETIONS``."""
        e, at = self.epoch, f"{self.root}/"
        references.where("key is not null and at_us is not null").write.parquet(f"{at}arrived/{e}")
        named = F.col("parent_id").cast("string")
        parents.where("key is not null and from_us is not null").withColumn("parent_id", named).write.parquet(f"{at}parents/{e}")
        deletions.where("until_us is not null").withColumn("parent_id", named).write.parquet(f"{at}deletions/{e}")
        fresh = self._read("arrived", REFERENCES, range(e, e + 1))
        all_parents, new_parents = self._read("parents", PARENTS, range(e + 1)), self._read("parents", PARENTS, range(e, e + 1))
        all_deletions, new_deletions = self._read("deletions", DELETIONS, range(e + 1)), self._read("deletions", DELETIONS, range(e, e + 1))
        before = self.waiting()
        # a settled reference counts unless a later batch reopened it (it may have settled again since)
        settled, undone = self._read("settled", SETTLED, range(e)), self._read("reopened", REOPENED, range(e))
        again = (settled["src_table"] == undone["src_table"]) & (settled["row_id"] == undone["row_id"]) & (undone["reopened"] > settled["settled"])
        settled = settled.join(undone, again, "left_anti").drop("settled")
        horizon = self._read("arrived", REFERENCES, range(e + 1)).agg(F.max("at_us")).head()[0] or 0
        index = self._held_index("index", self._index(all_parents, all_deletions), horizon)
        # new references probe the whole index
        orphans = self._probe(fresh, index, "left_anti")
        sound = self._probe(fresh, index, "left_semi")
        still = before
        if e:
            # waiting ones need only be held against the parents that have come, as they stand now
            fresh_parents = all_parents.join(new_parents.select("parent_id").distinct(), "parent_id", "left_semi")
            come = self._held_index("come", self._index(fresh_parents, all_deletions), horizon)
            still = self._probe(before, come, "left_anti")
            sound = sound.unionByName(self._probe(before, come, "left_semi"))
            # deletions reopen what lies at or beyond them and has no other support
            cut = new_deletions.groupBy(F.col("link").alias("l"), F.col("key").alias("k")).agg(F.min("until_us").alias("cut"))
            touched = settled.join(cut, (F.col("link") == F.col("l")) & (F.col("key") == F.col("k")) & (F.col("at_us") >= F.col("cut")), "left_semi")
            self._probe(touched, index, "left_anti").write.parquet(f"{at}back/{e}")
            back = self._read("back", REFERENCES, range(e, e + 1))
            still = still.unionByName(back)
            back.select("src_table", "row_id", F.lit(e).alias("reopened")).write.parquet(f"{at}reopened/{e}")
        else:
            self.spark.createDataFrame([], REOPENED).write.parquet(f"{at}reopened/{e}")
        sound.withColumn("settled", F.lit(e)).write.parquet(f"{at}settled/{e}")
        still.unionByName(orphans).write.parquet(f"{at}waiting/{e}")
        self.epoch += 1
        counts = self.waiting().groupBy("src_table", F.date_format(F.timestamp_micros("at_us"), "yyyy-MM").alias("period"))
        counts.agg(F.count("*").alias("orphans")).select(F.lit(e).alias("epoch"), "src_table", "period", "orphans").write.parquet(f"{at}snapshots/{e}")


def replay(
    spark: SparkSession, references: DataFrame, parents: DataFrame, deletions: DataFrame, epochs: int = 3
) -> OrphanLedger:
    """A ledger that has taken in the three logs in ``epochs`` batches by their own times, as they would have come.

    The result doesn't depend on ``epochs``. Empty logs give an empty ledger.
    """
    logs = ((references, "at_us"), (parents, "from_us"), (deletions, "until_us"))
    ends = [df.agg(F.min(c), F.max(c)).head() for df, c in logs]
    low, high = min((r[0] for r in ends if r[0] is not None), default=0), max((r[1] for r in ends if r[1] is not None), default=0)
    ledger = OrphanLedger(spark)
    for e in range(epochs):
        a, b = (low + (high - low) * k // epochs for k in (e, e + 1))

        def arrived(df: DataFrame, c: str, a: int = a, b: int = b, e: int = e) -> DataFrame:
            after = F.lit(True) if e == 0 else F.col(c) > a
            return df.where(after & (F.lit(True) if e == epochs - 1 else F.col(c) <= b))

        ledger.apply(*(arrived(df, c) for df, c in logs))
    return ledger
