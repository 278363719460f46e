"""Text expressions: tokens, cleaning, chunks, labels, bands."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StructField, StructType, _parse_datatype_string

TOKEN = r"[\p{L}\p{N}_]+"
WHITE = r"[\s\p{Z}\x85]+"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
CHUNK_WORDS, CHUNK_OVERLAP, MIN_CHARS = 800, 150, 20
#: Files of several pages whose names may be broadcast.
BROADCAST_FILES = 200_000
# Words that never count as significant.
STOPWORDS = "what that this with from have been they their which when where there about more also each into than then some will would could should these those".split()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def clean(text: Column) -> Column:
    t = F.regexp_replace(text, CONTROL, " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    return F.regexp_replace(t, rf"^{WHITE}|{WHITE}$", "")


def words(text: Column) -> Column:
    """Runs between white space; control characters count as such."""
    return F.array_remove(F.split(text, f"[{WHITE[1:-2]}{CONTROL[1:-1]}]+"), "")


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.?!])\s+")


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def size_label(n_bytes: Column, kb_digits: int = 1) -> Column:
    """B, KB or MB, halves rounded up."""
    kb, mb = n_bytes / 1024, n_bytes / (1 << 20)
    some = F.when(n_bytes < 1024, F.concat(n_bytes.cast("string"), F.lit(" B"))).when(n_bytes < 1 << 20, F.format_string(f"%.{kb_digits}f KB", kb))
    return some.otherwise(F.format_string("%.1f MB", mb))


def escape_html(text: Column) -> Column:
    """Text for a page; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def citation_label(path: Column, page: Column | None = None) -> Column:
    """The stem's words, acronyms as they are and others capitalised, and the page."""
    parts = F.filter(F.split(F.regexp_replace(stem(path), "[-_]+", " "), WHITE), lambda w: w != "")
    label = F.array_join(F.transform(parts, lambda w: F.when(w.rlike("^[A-Z][A-Z0-9s]*$"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10**6))))), " ")
    return label if page is None else F.when(page > 0, F.concat(label, F.lit(", p."), page.cast("string"))).otherwise(label)


def citations(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\[Source\s+(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def significant(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) >= 4) & ~w.isin(STOPWORDS)))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


#: Parts of an exact sum: whole numbers of 2**-32, 2**-64, ... besides whole ones.
LIMBS = 5


def limbs(x: Column) -> list[Column]:
    """A double as whole numbers of 1, 2**-32, 2**-64, 2**-96 and 2**-128, without an
    error for values from 2**-75 up: their sums are exact, in whatever order."""
    sign, rest, out = F.signum(x).cast("long"), F.abs(x), []
    for _ in range(LIMBS):
        whole = F.floor(rest)
        out.append(sign * whole)
        rest = (rest - whole) * float(1 << 32)
    return out


def exact_mean(x: Column, digits: int) -> Column:
    """An aggregate: the mean of doubles, rounded as Python rounds sum / n, for any
    order and partitioning of the rows. Null if there is none; nulls do not count. A
    mean with infinite or undefined values is what ``avg`` gives."""
    x = x.cast("double")
    odd = F.isnan(x) | (F.abs(x) >= float(1 << 52))
    fine = F.when(~odd, x)
    # No nulls, which would turn the sums into floats on their way.
    mean = _mean_of(*[F.coalesce(F.sum(part), F.lit(0).cast("long")) for part in limbs(fine)], F.count(x), F.lit(digits))
    return F.when(F.count_if(odd) > 0, F.round(F.avg(x), digits)).otherwise(mean)


@F.pandas_udf(DoubleType())
def _mean_of(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, n: pd.Series, digits: pd.Series) -> pd.Series:
    """One value a group, from its exact sum."""

    def one(parts, count, k):
        if not count:
            return None
        total = 0
        for part in parts:
            total = (total << 32) + int(part)
        return round(total / (1 << 32 * (LIMBS - 1)) / count, k)

    return pd.Series([one(row[:5], row[5], int(row[6])) for row in zip(a, b, c, d, e, n, digits)], dtype="float64")


def exact_round(x: Column, digits: int) -> Column:
    """Rounds the exact binary value, halves to even. ``round`` goes by the shortest
    decimal that names the value, which differs where that ends in a 5."""
    whole = F.floor(F.abs(x))
    # The fraction times 2**62 is a whole number for all but tiny values.
    unit = 1 << 62
    scaled = ((F.abs(x) - whole) * F.lit(float(unit))).cast("bigint").cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(10,0)")
    base = F.call_function("div", scaled, F.lit(unit).cast("decimal(20,0)"))
    rest = scaled - base.cast("decimal(30,0)") * F.lit(unit).cast("decimal(20,0)")
    half = F.lit(unit // 2).cast("decimal(20,0)")
    up = (rest > half) | ((rest == half) & (F.pmod(base, F.lit(2)) == 1))
    units = whole * 10**digits + base + up.cast("bigint")
    return F.signum(x) * units / F.lit(float(10**digits))


def or_one(x: Column) -> Column:
    """A divisor: 1 for null or 0."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(1.0))


def ago(minutes: Column) -> Column:
    return F.when(minutes < 1, F.lit("Just now")).when(minutes < 60, F.concat(minutes, F.lit("m ago"))).when(minutes < 1440, F.concat(F.floor(minutes / 60), F.lit("h ago"))).otherwise(F.concat(F.floor(minutes / 1440), F.lit("d ago")))


def band(x: Column, high: float = 0.7, low: float = 0.4) -> Column:
    return F.when(x >= high, "good").when(x >= low, "fair").otherwise("poor")


# What counts as high and as low on each page.
BANDS = {"answer": (0.70, 0.40), "statistic": (0.80, 0.65), "relevance": (0.65, 0.45), "card": (0.75, 0.50), "category": (1.0, 0.5)}


def band_of(page: str, x: Column) -> Column:
    return band(x, *BANDS[page])


def error_class(text: Column) -> Column:
    """What an error text is about; the first that matches."""

    def has(*keys: str) -> Column:
        out = F.lit(False)
        for k in keys:
            out = out | F.contains(F.lower(text), F.lit(k))
        return out

    # The words by which an error is known.
    limited = has("rate limit", "429", "quota", "tokens per day", "tpd")
    return F.when(limited & has("perday", "per_day", "daily"), "daily quota").when(limited, "rate limit").when(has("authentication", "401", "api key", "api_key"), "authentication").when(has("not set"), "missing key").when(has("timeout", "connection"), "timeout").otherwise("other")


def retry_seconds(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"retry in (\d+(?:\.\d+)?)s", 1).try_cast("double") + 2, F.lit(15.0))


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(text, F.lit(p))
    return out


def struct_of(**fields) -> StructType:
    """A schema of names with types or type names."""
    return StructType([StructField(n, t if isinstance(t, DataType) else _parse_datatype_string(t)) for n, t in fields.items()])


def history(messages: DataFrame, group: str, order: str, n: int, line: Column) -> DataFrame:
    """(group, history): the last ``n`` messages of each group as lines, oldest
    first; empty lines are left out."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    last = messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    lines = F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line"))))
    return last.groupBy(group).agg(F.array_join(F.filter(F.transform(lines, lambda x: x["line"]), lambda x: x != ""), "\n").alias("history"))


def router_history(messages: DataFrame, group: str, order: str) -> DataFrame:
    """The last three turns, 200 characters of each, under their roles."""
    line = F.concat(F.upper(F.substring("role", 1, 1)), F.lower(F.expr("substring(role, 2)")), F.lit(": "), F.substring("text", 1, 200))
    return history(messages, group, order, 3, line)


# The lines around a generator's history.
HISTORY_HEAD, HISTORY_FOOT = "\n--- CONVERSATION HISTORY (for context) ---", "--- END HISTORY ---\n"


def generator_history(messages: DataFrame, group: str, order: str) -> DataFrame:
    """The last six messages with texts, whole, between a head and a foot line."""
    said = F.regexp_replace(F.coalesce("text", F.lit("")), rf"^{WHITE}|{WHITE}$", "")
    line = F.when(said != "", F.concat(F.when(F.col("role") == "user", "Student").otherwise("Assistant"), F.lit(": "), said)).otherwise("")
    made = history(messages, group, order, 6, line)
    inner = F.when(F.col("history") != "", F.concat("history", F.lit("\n"))).otherwise("")
    return made.withColumn("history", F.concat(F.lit(HISTORY_HEAD + "\n"), inner, F.lit(HISTORY_FOOT)))


def chunks(files: DataFrame, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` words every ``size - overlap`` from (domain, source_file,
    page, text, ...), numbered through each file; those of 20 characters or less
    are dropped. chunk_id is domain_stem_number. Only files of several rows (pages)
    are brought together, before they are cut, so that overlaps are not shuffled;
    the text of the others stays where it is read."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step = size - overlap

    def cut(rows: DataFrame) -> DataFrame:
        w = rows.withColumn("_w", words(F.col("text"))).drop("text")
        starts = F.sequence(F.lit(0), F.ceil(F.greatest(F.size("_w") - size, F.lit(0)) / F.lit(float(step))).cast("int"))
        parts = F.transform(starts, lambda i: F.array_join(F.slice("_w", i * step + 1, F.lit(size)), " "))
        return w.withColumn("_t", F.filter(parts, lambda x: F.length(x) > MIN_CHARS)).drop("_w")

    paged = files.groupBy("domain", "source_file").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("domain").alias("_d"), F.col("source_file").alias("_f"))
    n = paged.limit(BROADCAST_FILES + 1).count()
    if not n:
        w = cut(files).withColumn("_n", F.lit(0).cast("long"))
    else:
        same = F.col("domain").eqNullSafe(F.col("_d")) & F.col("source_file").eqNullSafe(F.col("_f"))
        paged = F.broadcast(paged) if n <= BROADCAST_FILES else paged
        # A file's pages are one key, as its numbers run through it; only pages' counts are summed.
        before = Window.partitionBy("domain", "source_file").orderBy(F.coalesce("page", F.lit(0))).rowsBetween(Window.unboundedPreceding, -1)
        several = cut(files.join(paged, same, "left_semi")).withColumn("_n", F.coalesce(F.sum(F.size("_t")).over(before), F.lit(0)))
        w = cut(files.join(paged, same, "left_anti")).withColumn("_n", F.lit(0).cast("long")).unionByName(several)
    # An inner explode of a column is preceded by a filter on its size, which would move
    # below the projection and cut the texts once more.
    w = w.select(*[c for c in files.columns if c != "text"], "_n", F.posexplode_outer("_t").alias("_i", "text")).where(F.col("text").isNotNull())
    w = w.withColumn("chunk_index", (F.col("_n") + F.col("_i")).cast("int")).drop("_n", "_i")
    w = w.select(*files.columns, "chunk_index")
    return w.withColumn("chunk_id", F.format_string("%s_%s_%04d", "domain", stem(F.col("source_file")), "chunk_index"))
