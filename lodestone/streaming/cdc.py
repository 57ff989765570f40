"""Change logs: envelopes, folding into current state, versions, dead letters and carried fields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

OPS, UPSERTS = ("c", "u", "r", "d"), ("c", "u", "r")
MOST_ERROR, MOST_ATTEMPTS, MOST_REPLAY = 500, 3, 100


def envelope(row: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("op", T.StringType()), T.StructField("before", row), T.StructField("after", row), T.StructField("_corrupt", T.StringType())])


def parse(log: DataFrame, row: T.StructType, body: str = "body") -> DataFrame:
    """Adds op, before, after and kind: SKIP for a body that is blank or no object, FAIL for broken JSON, else WRITE."""
    text = F.trim(F.coalesce(F.col(body), F.lit("")))
    parsed = F.from_json(F.col(body), envelope(row), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = log.withColumn("__e", parsed)
    kind = F.when((text == "") | ~text.startswith("{"), "SKIP").when(F.col("__e").isNull() | F.col("__e._corrupt").isNotNull(), "FAIL").otherwise("WRITE")
    return out.select(*log.columns, F.col("__e.op").alias("op"), F.col("__e.before").alias("before"), F.col("__e.after").alias("after"), kind.alias("kind"))


def applicable(key: str) -> Column:
    """Upserts with a row and key, deletes with the key of the row before. All others change nothing."""
    return (F.col("op").isin(*UPSERTS) & F.col(f"after.{key}").isNotNull()) | ((F.col("op") == "d") & F.col(f"before.{key}").isNotNull())


def dispatch(parsed: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, deleted, after) of changes that apply."""
    writes = parsed.where((F.col("kind") == "WRITE") & applicable(key)) if "kind" in parsed.columns else parsed.where(applicable(key))
    return writes.select(F.when(F.col("op") == "d", F.col(f"before.{key}")).otherwise(F.col(f"after.{key}")).alias("key"), F.col(order).alias("ord"), (F.col("op") == "d").alias("deleted"), "after")


def fold(changes: DataFrame) -> DataFrame:
    """The last change of each key; one aggregate with partial maxima, so a hot key costs one row a task."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("ord", "deleted", "after"), "ord").alias("last"))
    return last.select("key", "last.ord", "last.deleted", "last.after")


def state(changes: DataFrame) -> DataFrame:
    """Current rows: the last change of each key unless it deletes."""
    return fold(changes).where("not deleted").select("after.*")


def versions(changes: DataFrame, entity: str, batch: str | None = None) -> DataFrame:
    """Version of an entity: one step per batch that changed something, or per change without batches."""
    n = F.countDistinct(batch) if batch else F.count(F.lit(1))
    return changes.agg(n.alias("version")).select(F.lit(entity).alias("entity"), "version")


def dead_letter(parsed: DataFrame, namespace: str, entity: str, stream: str, group: str, order: str, body: str, error: Column, attempts: Column) -> DataFrame:
    return parsed.select(
        F.lit(namespace).alias("ns"), F.lit(entity).alias("entity"), F.lit(stream).alias("originStream"), F.lit(group).alias("originGroup"),
        F.col(order).cast("string").alias("msgId"), F.lit("body").alias("msgKey"), F.col(body).alias("payload"), attempts.cast("string").alias("deliveryCount"),
        F.unix_millis(F.current_timestamp()).cast("string").alias("failedAt"), F.substring(error, 1, MOST_ERROR).alias("error"),
    )


def fill_carried(children: DataFrame, parents: DataFrame, fk: str, pk: str, source: str, target: str) -> DataFrame:
    """Children with the parent's column copied through the foreign key; where there is no parent, or its column isn't
    set, a child keeps what it has."""
    from_parent = parents.select(F.col(pk).alias("__pk"), F.col(source).alias("__v"))
    own = F.col(target) if target in children.columns else F.lit(None)
    met = children.join(from_parent, F.col(fk) == F.col("__pk"), "left")
    return met.withColumn(target, F.coalesce(F.col("__v"), own)).drop("__pk", "__v")


def propagate(children: DataFrame, changed: DataFrame, fk: str, pk: str, source: str, target: str) -> DataFrame:
    """All children of changed parents get the new value, null included; others keep theirs."""
    new = changed.select(F.col(pk).alias("__pk"), F.struct(F.col(source).alias("v")).alias("__new"))
    met = children.join(new, F.col(fk) == F.col("__pk"), "left")
    return met.withColumn(target, F.when(F.col("__new").isNotNull(), F.col("__new.v")).otherwise(F.col(target))).drop("__pk", "__new")


@dataclass(frozen=True)
class Carried:
    """A column that children take from the row that their foreign key names; ``parents`` reads the rows of today."""

    parents: Callable[[], DataFrame]
    fk: str
    pk: str
    source: str
    target: str


class Applier:
    """Applies micro-batches to a keyed Parquet state under ``root``.

    Every batch writes a new snapshot, named by the batch, from the last one; a replayed batch finds its own snapshot
    done and changes nothing. The state keeps deletions and each key's order, so that a late, older change
    never wins. Carried columns are filled from their parents as changes are applied, and ``spread`` brings a parent's
    new values to all children. What fails is tried again with the next batches, and is a dead letter after ``attempts``
    tries: a body that is broken, or whose row ``check`` refuses (a condition on op, before and after, such as that a
    referenced row has arrived, given with the error to state).
    """

    def __init__(self, spark: SparkSession, root: str, namespace: str, entity: str, row: T.StructType, key: str, order: str = "seq", body: str = "body", attempts: int = MOST_ATTEMPTS, carried: tuple[Carried, ...] = (), check: Callable[[DataFrame], Column] | None = None):
        self.spark, self.root, self.namespace, self.entity, self.row, self.key = spark, root.rstrip("/"), namespace, entity, row, key
        self.order, self.body, self.attempts, self.carried, self.check = order, body, attempts, carried, check
        self.state_schema = T.StructType([T.StructField("key", row[key].dataType), T.StructField("ord", T.LongType()), T.StructField("deleted", T.BooleanType()), T.StructField("after", row)])

    def _path(self, *parts) -> str:
        return "/".join([self.root, *map(str, parts)])

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def done(self) -> list[int]:
        p, fs = self._fs(self._path("state"))
        if not fs.exists(p):
            return []
        names = [s.getPath() for s in fs.listStatus(p)]
        jvm = self.spark.sparkContext._jvm
        return sorted(int(n.getName().split("=")[1]) for n in names if n.getName().startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))

    def snapshot(self, before: int | None = None) -> DataFrame:
        at = [b for b in self.done() if before is None or b < before]
        if not at:
            return self.spark.createDataFrame([], self.state_schema)
        return self.spark.read.schema(self.state_schema).parquet(self._path("state", f"batch={at[-1]}"))

    def current(self) -> DataFrame:
        return self.snapshot().where("not deleted").select("after.*")

    def version(self) -> int:
        """Batches that changed something."""
        p, fs = self._fs(self._path("versions"))
        return len([s for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=")]) if fs.exists(p) else 0

    def dead(self) -> DataFrame | None:
        p, fs = self._fs(self._path("dlq"))
        return self.spark.read.parquet(self._path("dlq")) if fs.exists(p) else None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id in self.done():
            return
        log = batch.select(F.col(self.order).cast("long").alias(self.order), self.body, F.lit(0).alias("tries"))
        log = log.unionByName(self.pending(batch_id).select(F.col(self.order).cast("long").alias(self.order), self.body, "tries"))
        parsed = parse(log, self.row, self.body)
        if self.check is not None:
            refused = (F.col("kind") == "WRITE") & applicable(self.key) & ~F.coalesce(self.check(parsed), F.lit(False))
            parsed = parsed.withColumn("kind", F.when(refused, "REFUSED").otherwise(F.col("kind")))
        failed = parsed.where("kind in ('FAIL', 'REFUSED')").withColumn("tries", F.col("tries") + 1)
        # each is processed before it is judged: a change that is mended by now is applied, whatever its tries
        failed.where(F.col("tries") < self.attempts).select(self.order, self.body, "tries").write.mode("overwrite").parquet(self._path("pending", f"batch={batch_id}"))
        spent = failed.where(F.col("tries") >= self.attempts)
        error = F.when(F.col("kind") == "FAIL", "broken JSON").otherwise("refused")
        if not spent.isEmpty():
            dead_letter(spent, self.namespace, self.entity, self.entity, "apply", self.order, self.body, error, F.col("tries")).write.mode("overwrite").parquet(self._path("dlq", f"batch={batch_id}"))
        changes = dispatch(parsed, self.key, self.order).withColumn("ord", F.col("ord").cast("long"))
        for c in self.carried:
            changes = self._filled(changes, c)
        if not changes.isEmpty():
            self.spark.range(1).write.mode("overwrite").parquet(self._path("versions", f"batch={batch_id}"))
        both = self.snapshot(batch_id).unionByName(changes.select("key", "ord", "deleted", "after"))
        fold(both).write.mode("overwrite").parquet(self._path("state", f"batch={batch_id}"))
        self._forget(batch_id)

    @staticmethod
    def _filled(changes: DataFrame, c: Carried) -> DataFrame:
        wide = changes.withColumns({"__fk": F.col(f"after.{c.fk}"), "__own": F.col(f"after.{c.target}")})
        wide = fill_carried(wide, c.parents(), "__fk", c.pk, c.source, "__own")
        return wide.withColumn("after", F.when(F.col("after").isNotNull(), F.col("after").withField(c.target, F.col("__own")))).drop("__fk", "__own")

    def spread(self, changed: DataFrame, c: Carried, batch_id: int) -> None:
        """All children of changed parents get the parents' values, null included; a batch of its own."""
        if batch_id in self.done():
            return
        rows = self.snapshot(batch_id).withColumns({"__fk": F.col(f"after.{c.fk}"), "__own": F.col(f"after.{c.target}")})
        rows = propagate(rows, changed, "__fk", c.pk, c.source, "__own")
        rows = rows.withColumn("after", F.when(F.col("after").isNotNull(), F.col("after").withField(c.target, F.col("__own"))))
        self.pending(batch_id).write.mode("overwrite").parquet(self._path("pending", f"batch={batch_id}"))
        self.spark.range(1).write.mode("overwrite").parquet(self._path("versions", f"batch={batch_id}"))
        rows.select("key", "ord", "deleted", "after").write.mode("overwrite").parquet(self._path("state", f"batch={batch_id}"))
        self._forget(batch_id)

    def pending(self, before: int | None = None) -> DataFrame:
        """Changes that failed and have tries left."""
        at = [b for b in self.done() if before is None or b < before]
        shape = f"`{self.order}` bigint, `{self.body}` string, tries int"
        return self.spark.read.schema(shape).parquet(self._path("pending", f"batch={at[-1]}")) if at else self.spark.createDataFrame([], shape)

    def _forget(self, batch_id: int, keep: int = 2) -> None:
        """Removes snapshots that later ones stand for; the last ``keep`` stay."""
        for b in [b for b in self.done() if b <= batch_id][:-keep]:
            # a folder that is left without its mark counts as done no more, so the mark goes last
            for top in ("pending", "state"):
                p, fs = self._fs(self._path(top, f"batch={b}"))
                if top == "pending":
                    fs.delete(p, True)
                else:
                    for s in fs.listStatus(p):
                        if s.getPath().getName() != "_SUCCESS":
                            fs.delete(s.getPath(), True)

    def start(self, log: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = log.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def replay(self, batch_id: int, most: int = MOST_REPLAY, mend=None) -> int:
        """Dead letters, oldest first, as a new batch; ``mend`` may repair their payloads. What still fails is a dead
        letter of that batch again.

        Letters are deleted once the batch is applied: the others are moved to a new folder first, and then the folders
        that were read are deleted. A call that breaks off loses none; it may leave letters that were applied, which
        change nothing when they are replayed. A batch that was done already replays nothing."""
        p, fs = self._fs(self._path("dlq"))
        if not fs.exists(p) or batch_id in self.done():
            return 0
        own = f"batch={batch_id}"  # of an attempt that broke off; its letters are still where they were
        folders = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=") and s.getPath().getName() != own]
        if not folders:
            return 0
        fs.delete(self._fs(self._path("dlq", own))[0], True)
        letters = self.spark.read.option("basePath", p.toString()).parquet(*[f.toString() for f in folders])
        letters = letters.drop("batch").withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
        body = F.col("payload") if mend is None else mend(F.col("payload"))
        seq = F.col("msgId").cast("long")
        chosen = letters.orderBy(seq, "__file", "__row").limit(most).select(seq.alias(self.order), body.alias(self.body), "__file", "__row")
        # at most ``most`` letters; the others stay on the executors
        held = self.spark.createDataFrame(chosen.collect(), chosen.schema)
        n = held.count()
        self.apply(held.drop("__file", "__row"), batch_id)
        rest = letters.join(F.broadcast(held.select("__file", "__row")), ["__file", "__row"], "left_anti").drop("__file", "__row")
        if not rest.isEmpty():
            aside, _ = self._fs(self._path(f"dlq-rest-{batch_id}"))
            rest.write.mode("overwrite").parquet(aside.toString())
            if not fs.rename(aside, self._fs(self._path("dlq", f"batch={-2 - batch_id}"))[0]):
                raise OSError(f"{aside.toString()} can't be moved to the dead letters")
        for folder in folders:
            fs.delete(folder, True)
        if not [s for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=")]:
            fs.delete(p, True)
        return n


def metrics(log: DataFrame, done: int, order: str, letters: DataFrame | None) -> dict:
    """Backlog and lag of a log against the last order applied, and dead letters."""
    row = log.agg(F.count(F.lit(1)).alias("size"), F.max(order).alias("last"), F.sum((F.col(order) > done).cast("long")).alias("lag")).first()
    return {"size": row["size"], "last": row["last"], "lag": row["lag"] or 0, "dead": letters.count() if letters is not None else 0}
