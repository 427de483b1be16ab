"""The folded table between batches: versioned Parquet, or a JDBC target.

Spark ships no table format with row-level writes, so a table is a folded base
plus the change rows of the batches since. A batch only appends its own change
rows, whatever the size of the table. When they have grown to a set share of the
base they are folded into a new one, so every row is rewritten a bounded number
of times. Beside the base stand the few change rows per key that it follows from;
keys that change are folded anew from these, so it makes no difference when the
base was made, nor in which order or batches the changes arrived. A batch becomes
visible when its manifest, one row, is complete.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.fold import LAST_ORDER, LIVE, SET_SUFFIX, FoldSpec, fold, retained
from tidemark.plans.routing import APPLIED
from tidemark.sizing import SMALL_ROWS, is_small

MANIFEST = """version bigint, step int, base string, base_rows bigint, changes array<string>,
    change_rows bigint, streams map<string, bigint>"""


EMPTY = {"version": -1, "step": 0, "base": None, "base_rows": 0, "changes": [], "change_rows": 0, "streams": {}}


class CommitLog:
    """What many tables consist of, in one row per table; one commit is valid for all of them.

    Every commit repeats the tables that it does not change, so that the newest alone is read.
    There are as many rows as tables. Commits before the last ``keep`` are deleted now and then,
    and with them the files that none of the others refers to.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 10):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _listed(self) -> list[Row]:
        try:
            return self.spark.read.schema(f"commit bigint, at string, {MANIFEST}").parquet(self.path).collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def newest(self) -> dict[str, Row]:
        """The manifest of each table by its path."""
        listed = self._listed()
        last = max((r["commit"] for r in listed), default=None)
        return {r["at"]: r for r in listed if r["commit"] == last}

    def commit(self, manifests: dict[str, dict]) -> None:
        known = self.newest()
        number = 1 + max((r["commit"] for r in known.values()), default=-1)
        rows = {at: r.asDict() for at, r in known.items()} | manifests
        values = [(at, *[m[f] for f in EMPTY]) for at, m in sorted(rows.items())]
        self.spark.createDataFrame(values, f"at string, {MANIFEST}").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/commit={number}")
        if number % (2 * self.keep) == 2 * self.keep - 1:
            self.expire()

    def expire(self) -> None:
        listed = self._listed()
        numbers = sorted({r["commit"] for r in listed})
        kept, gone = set(numbers[-self.keep:]), numbers[:-self.keep]

        def files(rows: list[Row]) -> set[str]:
            named = {change_path(r["at"], c) for r in rows for c in r["changes"]}
            return named | {f"{r['at']}/{kind}/{r['base']}" for r in rows if r["base"] for kind in ("base", "history")}

        unused = files([r for r in listed if r["commit"] in gone]) - files([r for r in listed if r["commit"] in kept])
        for path in [*unused, *(f"{self.path}/commit={n}" for n in gone)]:
            delete(self.spark, path)


def change_path(table: str, name: str) -> str:
    """A table's own change files are named, those it shares with others given by their path."""
    return name if "/" in name else f"{table}/changes/{name}"


class KeyedTable:
    """A table of one row per key, kept under ``path`` on storage all executors share.

    ``share`` is how large the pending change rows may grow beside the base, and
    ``at_least`` how many there must be, before they are folded into it; more than
    ``folders`` batches of them are put together in one folder before that. With at
    most ``small`` changed keys the base is not shuffled to be read. Versions number the
    batches taken in, whatever their own numbers. Files of versions before the last
    ``keep`` are deleted now and then, so a reader may take as long as that many batches.

    With a ``log`` the table is one of many that are committed together, and changes may be
    in files written for all of them: rows of one kind, with the columns of this table in
    the struct named ``shared`` and its key in ``key``.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        spec: FoldSpec,
        share: float = 0.5,
        at_least: int = 1_000_000,
        small: int = SMALL_ROWS,
        keep: int = 10,
        folders: int = 100,
        log: CommitLog | None = None,
        shared: str | None = None,
    ):
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec
        self.share, self.at_least, self.small, self.keep = share, at_least, small, keep
        self.folders = folders
        self.log, self.shared = log, shared

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _newest(self) -> Row | None:
        if self.log is not None:
            return self.log.newest().get(self.path)
        manifests = self._manifests()
        if manifests is None:
            return None
        newest = F.max_by(F.struct(*manifests.columns), F.struct("version", "step")).alias("m")
        return manifests.agg(newest).first()["m"]

    def version(self) -> int | None:
        """Version of the last completed batch."""
        manifest = self._newest()
        return None if manifest is None else manifest["version"]

    def _base(self, manifest: Row) -> DataFrame | None:
        if manifest["base"] is None:
            return None
        return self.spark.read.parquet(f"{self.path}/base/{manifest['base']}")

    def _pending(self, manifest: Row) -> DataFrame | None:
        def read(paths: list[str]) -> DataFrame:
            # Later batches may carry columns mapped since; earlier ones did not set them.
            return self.spark.read.option("mergeSchema", True).parquet(*paths)

        shared = [name for name in manifest["changes"] if "/" in name]
        own = [change_path(self.path, name) for name in manifest["changes"] if "/" not in name]
        parts = [read(own)] if own else []
        if shared:
            rows = read(shared).filter(F.col("outcome") == APPLIED)
            parts.append(rows.select(F.col("key").alias(self.spec.key[0]), *self.spec.order, self.spec.kind,
                                     f"{self.shared}.*"))
        return _together(*parts) if parts else None

    def _history(self, manifest: Row) -> DataFrame | None:
        """The change rows that the base follows from."""
        if manifest["base"] is None:
            return None
        return self.spark.read.parquet(f"{self.path}/history/{manifest['base']}")

    def tracked(self, manifest: Row | None = None) -> DataFrame | None:
        """All rows with ``live`` and ``last_order``, deleted keys included; now or at a manifest."""
        manifest = self._newest() if manifest is None else manifest
        return None if manifest is None else self._folded(manifest)

    def _folded(self, manifest: Row) -> DataFrame | None:
        base, pending = self._base(manifest), self._pending(manifest)
        if pending is not None:
            pending = _with_columns(pending, self.spec.columns, base, sets=True)
        if base is not None:
            base = _with_columns(base, self.spec.columns, pending)
        if pending is None:
            return base
        if base is None:
            return fold(pending, self.spec, track=True)
        history = self._history(manifest)
        keys = pending.select(*self.spec.key).distinct()
        if not is_small(keys, self.small):
            return fold(_together(history, pending), self.spec, track=True)
        # Few keys changed: the rest of the base passes by without a shuffle.
        key = list(self.spec.key)
        touched = history.join(F.broadcast(keys), key, "left_semi")
        folded = fold(_together(touched, pending), self.spec, track=True)
        return folded.unionByName(base.join(F.broadcast(keys), key, "left_anti"))

    def rows(self) -> DataFrame | None:
        """The table as its readers see it."""
        tracked = self.tracked()
        return None if tracked is None else tracked.filter(LIVE).drop(LIVE, LAST_ORDER)

    def apply(self, changes: DataFrame, batch: int, stream: str = "") -> None:
        """Take in a batch of a stream; one that the table has of this stream is not redone.

        Numbers of another stream say nothing: one with a new checkpoint begins at 0 again.
        """
        manifest = self._newest()
        before = manifest.asDict() if manifest is not None else EMPTY
        if before["streams"].get(stream, -1) >= batch:
            return
        name = f"version={before['version'] + 1}"
        target = f"{self.path}/changes/{name}"
        sets = [c + SET_SUFFIX for c in self.spec.columns]
        wanted = [*self.spec.key, *self.spec.order, self.spec.kind, *self.spec.columns, *sets]
        changes.select(*dict.fromkeys(wanted)).write.mode("overwrite").parquet(target)
        # Counted from the file footers.
        arrived = self.spark.read.parquet(target).count()
        after = self.taken(before, name, arrived, batch, stream)
        self._commit(after)
        if self.log is None and after["version"] % (2 * self.keep) == 2 * self.keep - 1:
            self.expire(self.keep)

    def taken(self, before: dict, name: str, arrived: int, batch: int, stream: str) -> dict:
        """The manifest with one more batch, whose change files are there already."""
        after = {
            **before, "version": before["version"] + 1, "step": 0,
            "streams": {**before["streams"], stream: batch},
            "changes": [*before["changes"], name] if arrived else before["changes"],
            "change_rows": before["change_rows"] + arrived,
        }
        if after["change_rows"] > max(self.at_least, self.share * after["base_rows"]):
            return self._compacted(after)
        return self._gathered(after) if len(after["changes"]) > self.folders else after

    def _gathered(self, manifest: dict) -> dict:
        """The pending changes put together in one folder."""
        name = f"until={manifest['version']}"
        self._pending(Row(**manifest)).write.mode("overwrite").parquet(f"{self.path}/changes/{name}")
        return {**manifest, "changes": [name]}

    def _compacted(self, manifest: dict, before: Column | None = None) -> dict:
        """A new base with its history. With ``before``, deleted keys whose last change comes
        before it are left out of both.
        """
        pending, history = self._pending(Row(**manifest)), self._history(Row(**manifest))
        parts = [part for part in (history, pending) if part is not None]
        if not parts:
            return manifest
        folded = self._folded(Row(**manifest))
        base = f"{manifest['version']}-{manifest['step']}"
        rows_at, history_at = f"{self.path}/base/{base}", f"{self.path}/history/{base}"
        kept = retained(_together(*parts), self.spec)
        if before is not None:
            key = list(self.spec.key)
            folded = folded.filter(F.col(LIVE) | (F.col(LAST_ORDER) >= before))
            recent = kept.groupBy(*key).agg(F.max(self.spec.order_value()).alias(LAST_ORDER)).filter(
                F.col(LAST_ORDER) >= before).select(*key)
            live = folded.filter(LIVE).select(*key)
            kept = kept.join(recent.union(live).distinct(), key, "left_semi")
        kept.write.mode("overwrite").parquet(history_at)
        folded.write.mode("overwrite").parquet(rows_at)
        rows = self.spark.read.parquet(rows_at).count()
        return {**manifest, "base": base, "base_rows": rows, "changes": [], "change_rows": 0}

    def _commit(self, manifest: dict) -> None:
        if self.log is not None:
            return self.log.commit({self.path: manifest})
        row = self.spark.createDataFrame([{f: manifest[f] for f in EMPTY}], MANIFEST)
        target = f"{self.path}/manifest/version={manifest['version']}/step={manifest['step']}"
        row.drop("version", "step").coalesce(1).write.mode("overwrite").parquet(target)

    def forget_deleted(self, before: Column) -> None:
        """Fold everything and drop the marks of keys deleted before an order that no
        change still to come can precede. Call it between batches.

        The table stays at its version, which numbers batches, and takes a further step.
        """
        manifest = self._newest()
        if manifest is None:
            return
        after = {**manifest.asDict(), "step": manifest["step"] + 1}
        self._commit(self._compacted(after, before))

    def expire(self, keep: int) -> None:
        """Delete files that none of the newest ``keep`` manifests refers to; a log does it itself."""
        manifests = self._manifests()
        if manifests is None:
            return
        listed = sorted(manifests.collect(), key=lambda m: (m["version"], m["step"]))
        kept, gone = listed[-keep:], listed[:-keep]
        bases = {m["base"] for m in kept}
        changes = {v for m in kept for v in m["changes"]}
        for m in gone:
            step = f"version={m['version']}/step={m['step']}"
            delete(self.spark, f"{self.path}/manifest/{step}")
        for base in {m["base"] for m in gone} - bases - {None}:
            delete(self.spark, f"{self.path}/base/{base}")
            delete(self.spark, f"{self.path}/history/{base}")
        for name in {n for m in gone for n in [*m["changes"], f"version={m['version']}"]} - changes:
            delete(self.spark, f"{self.path}/changes/{name}")


def _together(*changes: DataFrame) -> DataFrame:
    """Change rows of several files; a column that some were written without is not set there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), changes)


def _with_columns(
    rows: DataFrame, columns: tuple[str, ...], like: DataFrame | None, sets: bool = False
) -> DataFrame:
    """Columns mapped after ``rows`` were written are NULL in them, and not set by changes."""
    missing = [c for c in columns if c not in rows.columns]
    types = {} if like is None else {f.name: f.dataType for f in like.schema.fields}
    added = {c: F.lit(None).cast(types.get(c, T.StringType())) for c in missing}
    if sets:
        added |= {c + SET_SUFFIX: F.lit(False) for c in missing}
    return rows.withColumns(added)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system it is on."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """A target table in a database, read in key ranges when ``bounds`` are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key is not None and bounds is not None:
        reader = reader.options(
            partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1],
            numPartitions=partitions,
        )
    return reader.load()


def write_jdbc(rows: DataFrame, url: str, table: str, replace: bool = False, **options: str) -> None:
    """Append to a database table, or replace its rows while keeping its definition."""
    writer = rows.write.format("jdbc").options(url=url, dbtable=table, **options)
    if replace:
        writer = writer.option("truncate", "true")
    writer.mode("overwrite" if replace else "append").save()


def for_dialect(rows: DataFrame, dialect: str, flag: str | None = None) -> DataFrame:
    """Adapt folded rows to a target's types: no booleans or timestamps on SQLite."""
    if dialect != "sqlite":
        return rows
    casts = {}
    for f in rows.schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            casts[f.name] = F.col(f.name).cast("int")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            casts[f.name] = F.col(f.name).cast("string")
    return rows.withColumns(casts)
