"""The row store as DataFrame operations: schemas, constraints, upserts, deletes, roll-ups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources import scratch

SCHEMAS = {
    "self_study_sessions": "id long, ss_session_id string, name string, description string, created_at timestamp, updated_at timestamp",
    "self_study_documents": "id long, ss_session_id string, filename string, file_type string, file_size_bytes long, chunk_count int, upload_timestamp timestamp",
    "self_study_chunks": "id long, chunk_id string, ss_session_id string, text string, source_file string, page_number int, chunk_index int, created_at timestamp",
    "self_study_messages": "id long, ss_session_id string, role string, content string, timestamp timestamp, quality_score double, pipeline_meta string",
    "chat_sessions": "id long, session_id string, title string, created_at timestamp, updated_at timestamp",
    "chat_messages": "id long, session_id string, role string, content string, timestamp timestamp, intent_type string, detected_domains array<string>, quality_score double, pipeline_meta string",
    "uploaded_documents": "id long, filename string, domain string, upload_timestamp timestamp, file_type string, chunk_count int, file_size_bytes long",
    "document_chunks": "id long, chunk_id string, domain string, text string, source_file string, page_number int, chunk_index int, created_at timestamp",
}
PARTITIONS = {"document_chunks": "domain", "self_study_chunks": "ss_session_id"}


def create_all(spark, folder: str) -> None:
    """Empty tables where there are none."""
    for name, schema in SCHEMAS.items():
        w = spark.createDataFrame([], schema).write.mode("ignore")
        (w.partitionBy(PARTITIONS[name]) if name in PARTITIONS else w).parquet(f"{folder}/{name}")


def read_table(spark, folder: str, name: str) -> DataFrame:
    """A table with its columns in order, also while it has no file."""
    columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}").select(*columns)


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df`` in place of the table at ``path``, from which it may read: a full
    copy is made first and then swapped in by renames, so that an error on the way
    leaves the old rows. One table at a time; Parquet has no wider transactions."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    at, to, away = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.parquet(new)
    except Exception:
        fs.delete(to, True)
        raise
    there = fs.exists(at)
    if there and not fs.rename(at, away):
        raise OSError(f"cannot move {path}")
    if not fs.rename(to, at):
        if there:
            fs.rename(away, at)
        raise OSError(f"cannot replace {path}")
    fs.delete(away, True)


def require_role(messages: DataFrame, roles: tuple = ("user", "assistant")) -> DataFrame:
    """``messages``, with an error at the first row that breaks the constraint."""
    ok = F.col("role").isin(*roles)
    return messages.withColumn("role", F.when(ok, F.col("role")).otherwise(F.raise_error(F.concat(F.lit("role not allowed: "), F.coalesce("role", F.lit("null"))))))


def matching(rows: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the given values; None asks nothing of a column."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def containing(rows: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose column holds ``part``, whatever its case."""
    return rows.where(F.contains(F.lower(column), F.lit(part.lower())))


def chunks_of(chunks: DataFrame, key: str, value, order: str = "id") -> DataFrame:
    """A domain's or session's chunks in insertion order. The tables are laid out by
    these keys, so that only its folder is read."""
    return chunks.where(F.col(key) == value).orderBy(order)


def ids_of(chunks: DataFrame, key: str, value, id_column: str = "chunk_id") -> DataFrame:
    return chunks.where(F.col(key) == value).select(id_column).distinct()


#: Bytes of a row group: small enough that a lookup reads little, large enough to scan.
ROW_GROUP = 16 << 20


def write_sorted(df: DataFrame, path: str, key: str, blooms: tuple = (), row_group: int = ROW_GROUP, files: int | None = None) -> None:
    """A table for lookups: sorted by ``key`` over its files, so that the bounds of
    files and row groups leave one of them, and with Bloom filters on ``blooms``, keys
    in another order, that leave the few that hold a value. Filters on either column
    are pushed down; nothing else is needed to read it so."""
    dealt = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    w = dealt.sortWithinPartitions(key).write.option("parquet.block.size", str(row_group)).option("parquet.block.size.row.check.min", "100")
    for column in blooms:
        w = w.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.enable.dictionary#{column}", "false")
    w.parquet(path)


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row with this key, if there is one."""
    return rows.where(F.col(key) == value).limit(1)


def with_chunks(documents: DataFrame, column: str = "chunk_count") -> DataFrame:
    return documents.where(F.col(column) > 0)


def recent(rows: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The ``n`` newest rows, newest first."""
    return rows.orderBy(F.desc(at), key).limit(n)


def transcript(messages: DataFrame, group: str, *order: str) -> DataFrame:
    """Messages with their place ``n`` in their group."""
    return messages.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def missing(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Ids of ``rows`` that ``known`` lacks."""
    return rows.select(key).join(known.select(key), key, "left_anti")


def both_lists(a: DataFrame, b: DataFrame) -> DataFrame:
    """One list after the other, repeats kept, columns by place."""
    return a.unionByName(b.toDF(*a.columns))


def numbered(rows: DataFrame, order: list[str], last: DataFrame) -> DataFrame:
    """``rows`` with an id behind the greatest of ``last`` (one row, last), in order:
    sorted by range and numbered part by part."""
    parts = scratch.stored(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    starts = parts.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    starts = starts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    made = parts.withColumn("_part", part).join(F.broadcast(starts), "_part").join(F.broadcast(last))
    return made.withColumn("id", F.col("_at") - F.col("_first") + F.col("_before") + F.col("last") + 1).drop("_at", "_part", "_first", "_before", "last")


def append_messages(messages: DataFrame, sessions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with ``new`` (session_id, role, content, timestamp, intent_type,
    detected_domains, quality_score, pipeline_meta) behind them, numbered on, arrays
    and structs as JSON; and the sessions, touched by their newest message."""
    last = messages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    kind = {f.name: f.dataType.typeName() for f in new.schema.fields}
    code = [F.when(F.size(c) > 0, F.to_json(c)).alias(c) if kind[c] == "array" else F.to_json(c).alias(c) if kind[c] in ("struct", "map") else F.col(c) for c in new.columns]
    added = numbered(require_role(new).select(*code), ["timestamp", "session_id", "role", "content"], last)
    touched = new.groupBy("session_id").agg(F.max("timestamp").alias("_at"))
    parents = sessions.join(touched, "session_id", "left").withColumn("updated_at", F.greatest("updated_at", "_at")).drop("_at")
    return messages.unionByName(added.select(*messages.columns)), parents.select(*sessions.columns)


def add_document(documents: DataFrame, new: DataFrame) -> DataFrame:
    """Document records with ``new`` ones behind them, numbered on."""
    last = documents.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    added = numbered(new, new.columns, last)
    return documents.unionByName(added.select(*documents.columns))


def remove_document(chunks: DataFrame, vectors: DataFrame, documents: DataFrame, where: Column, key: str = "chunk_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, vectors and records without those of the documents that ``where``
    (on source_file) names."""
    gone = chunks.where(where).select(key, "source_file")
    left = chunks.where(~F.coalesce(where, F.lit(False)))
    records = documents.join(gone.select(F.col("source_file").alias("filename")).distinct(), "filename", "left_anti").select(*documents.columns)
    return left, vectors.join(gone.select(key).distinct(), key, "left_anti").select(*vectors.columns), records


def reset(tables: dict[str, DataFrame], key: str, value) -> dict[str, DataFrame]:
    """All tables without a namespace's rows; a table that cannot be read stays out."""
    return {n: t.where(~F.col(key).eqNullSafe(F.lit(value))) for n, t in tables.items() if key in t.columns}


def upsert_chunks(chunks: DataFrame, new: DataFrame, embed=None) -> tuple[DataFrame, DataFrame | None]:
    """(all chunks, vectors of the added ones): ids that exist are left alone, the
    others are embedded by ``embed(text)`` and added."""
    added = new_rows(new, chunks, ["domain", "chunk_id"], ["source_file"])
    made = None if embed is None else added.select("domain", "chunk_id", embed(F.col("text")).alias("vector"))
    return chunks.unionByName(added.select(*chunks.columns)), made


def check_role(messages: DataFrame, roles: tuple = ("user", "assistant")) -> DataFrame:
    """Rows that satisfy the constraint."""
    return messages.where(F.col("role").isin(*roles))


def new_rows(new: DataFrame, old: DataFrame, key: list[str], order: list) -> DataFrame:
    """Insert-or-ignore: rows of ``new`` with keys not in ``old``, the first of equal keys."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return new.join(old.select(*key).distinct(), key, "left_anti").withColumn("_n", first).where("_n = 1").drop("_n")


def update(old: DataFrame, changes: DataFrame, key: list[str], columns: list[str], latest: str | None = None, nulls: bool = False) -> DataFrame:
    """Keyed update: values of ``changes`` replace those of ``old``. Of several changes
    to a key one counts as a whole, the one with the greatest ``latest``, then the
    greatest values. Its nulls leave the old values, or with ``nulls`` replace them."""
    order = F.struct(*([F.col(latest)] if latest else []), *[F.col(c) for c in columns])
    c = changes.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("_new"))
    new = lambda x: F.when(F.col("_new").isNotNull(), F.col(f"_new.{x}")).otherwise(F.col(x)) if nulls else F.coalesce(f"_new.{x}", x)
    return old.join(c, key, "left").select(*[new(x).alias(x) if x in columns else F.col(x) for x in old.columns])


def truncate_tail(rows: DataFrame, cuts: DataFrame, group: str, at: str) -> DataFrame:
    """Without rows at or after their group's cut (group, cut)."""
    return rows.join(cuts, group, "left").where(F.col("cut").isNull() | (F.col(at) < F.col("cut"))).drop("cut")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    return {n: t.join(gone.select(key).distinct(), key, "left_anti") for n, t in tables.items()}


def delete_where(rows: DataFrame, pred: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and what goes."""
    hit = F.coalesce(pred, F.lit(False))
    return rows.where(~hit), rows.where(hit)


def rollup(parents: DataFrame, children: DataFrame, key: str, **aggs: Column) -> DataFrame:
    """Parents with aggregates of their children, also those without any. Children
    are aggregated before the join, so a hot parent costs one row."""
    return parents.join(children.groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()]), key, "left")


def last_n(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with a header: quotes doubled, blanks kept, null as nothing between commas.
    ``files`` 1 makes one file of a report that fits a task."""
    out = (df.coalesce(files) if files else df).write.mode("overwrite").option("header", True)
    for side in ("Leading", "Trailing"):
        out = out.option(f"ignore{side}WhiteSpace", False)
    out.option("escape", '"').option("emptyValue", "").csv(path)


def read_csv(spark, path: str, schema: str) -> DataFrame:
    """What ``write_csv`` wrote."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
