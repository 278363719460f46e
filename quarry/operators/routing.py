"""Routing and splitting questions by domain keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import jsonx
from quarry.functions import text as T

#: Domain -> keywords, in registry order. Keywords match as substrings.
Keywords = dict[str, list[str]]


def hits(query: Column, keywords: Keywords) -> dict[str, Column]:
    low = F.lower(query)
    return {d: sum((F.contains(low, F.lit(k.lower())).cast("int") for k in ks), F.lit(0)) for d, ks in keywords.items()}


def domains(query: Column, keywords: Keywords) -> Column:
    """The domains with a keyword in the query, in registry order."""
    return F.filter(F.array(*[F.when(n > 0, F.lit(d)) for d, n in hits(query, keywords).items()]), lambda d: d.isNotNull())


def guess(query: Column, keywords: Keywords) -> Column:
    """The domain with most keywords; the first of equals; the first of all if none."""
    ordered = F.array(*[F.struct((-n).alias("n"), F.lit(i).alias("i"), F.lit(d).alias("d")) for i, (d, n) in enumerate(hits(query, keywords).items())])
    return F.array_min(ordered)["d"]


def route(queries: DataFrame, keywords: Keywords) -> DataFrame:
    """Adds domains, intent_type, is_related and needs_clarification."""
    q = F.col("query")
    found = queries.withColumn("domains", domains(q, keywords))
    n = F.size("domains")
    return found.withColumn("intent_type", F.when(n > 1, "multi").otherwise("single")).withColumn("is_related", n > 0).withColumn("needs_clarification", (F.size(T.words(q)) < 4) & (n == 0))


def searched(routed: DataFrame, keywords: Keywords) -> DataFrame:
    """(query_id, domain): the routed domains, or the best guess if there are none."""
    at = F.when(F.size("domains") > 0, F.col("domains")).otherwise(F.array(guess(F.col("query"), keywords)))
    return routed.select("query_id", F.explode(F.array_distinct(at)).alias("domain"))


def should_clarify(n_domains: Column, needs: Column, related: Column, query: Column) -> Column:
    return F.when(n_domains > 0, F.lit(False)).otherwise(needs | (related & (F.size(T.words(query)) < 5)))


def route_by(queries: DataFrame, keywords: Keywords, reply: Column) -> DataFrame:
    """``route`` by a model's ``reply``, a column of its answers. Null (it failed) and
    unreadable replies fall back to the keywords, and so do the domains of a related
    question for which none is known."""
    j = jsonx.route(reply, list(keywords))
    read = jsonx.parsed(reply)
    by = route(queries.withColumn("_j", j).withColumn("_read", read), keywords)
    said = F.transform(F.col("_j.domains"), lambda d: F.lower(d) if all(k == k.lower() for k in keywords) else d)
    found = F.when(~F.col("_read") | ((F.size(said) == 0) & F.col("_j.is_course_related")), F.col("domains")).otherwise(said)
    pick = lambda name, own: F.when(F.col("_read"), F.col(f"_j.{name}")).otherwise(F.col(own))
    return by.select(
        *queries.columns, found.alias("domains"), pick("intent_type", "intent_type").alias("intent_type"),
        pick("is_course_related", "is_related").alias("is_related"), pick("needs_clarification", "needs_clarification").alias("needs_clarification"),
    )


def override(manual: Column, routed: Column) -> Column:
    """Domains that the user chose by hand, if any, in place of the routed ones."""
    return F.when(F.coalesce(F.size(manual), F.lit(0)) > 0, manual).otherwise(routed)


# Words that make a question a general one.
GENERAL = "all any every across materials documents files uploaded everything overall summary overview important key".split()


def general_query(query: Column, names: Column) -> Column:
    """A question about all files: it names none of ``names`` (without their suffix)
    and holds one of the GENERAL words or fewer than eight words."""
    low = F.lower(query)
    named = F.exists(names, lambda n: F.contains(low, F.regexp_replace(F.lower(n), r"\.[^.]+$", "")))
    some = F.exists(F.array(*[F.lit(w) for w in GENERAL]), lambda w: F.contains(low, w))
    return ~named & (some | (F.size(F.split(query, " ")) < 8))


def split_by(routed: DataFrame, keywords: Keywords, reply: Column) -> DataFrame:
    """``split`` by a model's ``reply`` for questions of several intents: unknown
    domains are guessed from the sub-question; replies without any sub-question,
    null ones too, fall back to ``split``. Single questions stay whole."""
    known = [d.upper() for d in keywords]
    own = {d.upper(): d for d in keywords}
    names = F.create_map(*[F.lit(x) for kv in own.items() for x in kv])
    said = F.coalesce(jsonx.split_questions(reply), F.array().cast("array<struct<question:string,domain:string>>"))
    parts = F.transform(said, lambda q, i: F.struct(i.alias("pos"), q["question"].alias("question"), F.when(q["domain"].isin(known), names[q["domain"]]).otherwise(guess(q["question"], keywords)).alias("domain")))
    first = F.coalesce(F.try_element_at("domains", F.lit(1)), guess(F.col("query"), keywords))
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.col("query").alias("question"), first.alias("domain")))
    asked = routed.withColumn("_said", F.when(F.col("intent_type") == "single", whole).otherwise(parts))
    answered = asked.where(F.size("_said") > 0).select("query_id", F.explode("_said").alias("s")).select("query_id", "s.*")
    return answered.unionByName(split(asked.where(F.size("_said") == 0), keywords))


def split(routed: DataFrame, keywords: Keywords) -> DataFrame:
    """One row a sub-question (query_id, pos, question, domain): the sentences of
    a question with several domains go to these in turn."""
    s = F.filter(T.sentences(F.col("query")), lambda x: F.trim(x) != "")
    first = F.coalesce(F.try_element_at("domains", F.lit(1)), guess(F.col("query"), keywords))
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.col("query").alias("question"), first.alias("domain")))
    parts = F.transform(s, lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("question"), F.element_at("domains", (F.pmod(i, F.size("domains")) + 1).cast("int")).alias("domain")))
    several = (F.size("domains") > 1) & (F.size(s) > 1)
    return routed.select("query_id", F.explode(F.when(several, parts).otherwise(whole)).alias("s")).select("query_id", "s.*")
