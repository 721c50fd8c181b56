"""Search over symbols (id, name, qualified, kind, path): exact, prefix, fuzzy, regular expression and term queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import BETWEEN_TOKENS, TOKEN_EDGE, tokens_of

#: Bits of the fields that a token stands in.
FIELDS = {"name": 1, "qualified": 2, "path": 4, "kind": 8}


def dictionary(symbols: DataFrame) -> DataFrame:
    """Distinct names with their lower-case form."""
    return symbols.select("name").distinct().withColumn("lower_name", F.lower("name"))


def _ranked(hits: DataFrame, limit: int) -> DataFrame:
    return hits.orderBy(F.col("score").desc(), "value").limit(limit)


def exact(symbols: DataFrame, query: str, limit: int = 100) -> DataFrame:
    same = F.col("name") == query
    hits = dictionary(symbols).filter(F.col("lower_name") == query.lower()).select(F.col("name").alias("value"), F.when(same, 1_300_000).otherwise(1_200_000).alias("score"), F.when(same, "exact-case").otherwise("exact-case-insensitive").alias("reason"))
    return _ranked(hits, limit if query else 0)


def prefix(symbols: DataFrame, query: str, limit: int = 100) -> DataFrame:
    low, name = F.col("lower_name"), F.col("name")
    tiers = [(name == query, 1_300_000, "exact-case"), (low == query.lower(), 1_200_000, "exact-case-insensitive"), (name.startswith(query), 1_100_000, "prefix-case")]
    score, reason = F.lit(1_000_000), F.lit("prefix-case-insensitive")
    for test, points, why in reversed(tiers):
        score, reason = F.when(test, points).otherwise(score), F.when(test, why).otherwise(reason)
    return _ranked(dictionary(symbols).filter(low.startswith(query.lower())).select(name.alias("value"), score.alias("score"), reason.alias("reason")), limit if query else 0)


def fuzzy(symbols: DataFrame, query: str, limit: int = 100, most: int = 2) -> DataFrame:
    """Names within ``most`` edits of the query, case apart; lengths are compared first."""
    q = F.lit(query.lower())
    near = dictionary(symbols).filter(F.abs(F.length("lower_name") - len(query)) <= most).withColumn("distance", F.levenshtein(F.col("lower_name"), q, most)).filter("distance >= 0")
    return _ranked(near.select(F.col("name").alias("value"), (900_000 - 100_000 * F.col("distance")).alias("score"), F.concat(F.lit("fuzzy-distance-"), F.col("distance").cast("string")).alias("reason")), limit if query else 0)


def regex(symbols: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Unanchored, without regard to case; look-around and back-references are refused."""
    import re

    if re.search(r"\(\?(?:<?[=!]|>)|\\[1-9]", query):
        raise ValueError("look-around and back-references are not supported")
    re.compile(query)
    hits = dictionary(symbols).filter(F.col("name").rlike(f"(?i){query}")).select(F.col("name").alias("value"), F.lit(500_000).alias("score"), F.lit("regex").alias("reason"))
    return _ranked(hits, limit if query else 0)


def postings(symbols: DataFrame) -> DataFrame:
    """(token, id, name, fields): a row per token and definition, with the bits of the fields that hold it."""
    fields = F.array(*[F.struct(F.lit(bit).alias("bit"), tokens_of(F.col(c)).alias("tokens")) for c, bit in FIELDS.items()])
    flat = symbols.select("id", "name", F.explode(fields).alias("f")).select("id", "name", F.col("f.bit").alias("bit"), F.explode("f.tokens").alias("token"))
    return flat.groupBy("token", "id", "name").agg(F.bit_or("bit").alias("fields"))


def query_tokens(query: str) -> list[str]:
    """The query's distinct tokens of more than one byte, by the patterns of ``tokens_of``."""
    import regex

    parted = regex.sub(TOKEN_EDGE, " ", regex.sub(BETWEEN_TOKENS, " ", query))
    return [t for t in dict.fromkeys(parted.lower().split()) if len(t.encode()) > 1]


#: Folders of a stored term index; a token is in the one of its hash.
SHARDS = 64


def write_term_index(symbols: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Postings on disk in folders by their token's hash, sorted by token: a query reads its tokens' row groups only."""
    sharded = postings(symbols).withColumn("shard", F.pmod(F.xxhash64("token"), F.lit(shards)).cast("int"))
    sharded.repartition(shards, "shard").sortWithinPartitions("shard", "token").write.mode("errorifexists").partitionBy("shard").parquet(path)


def read_term_index(spark: SparkSession, path: str, tokens: list[str], shards: int = SHARDS) -> DataFrame:
    """The postings of some tokens from ``write_term_index``."""
    wanted = spark.createDataFrame([(t,) for t in tokens], "token string").select(F.pmod(F.xxhash64("token"), F.lit(shards)).cast("int")).distinct()
    stored = spark.read.schema("token string, id string, name string, fields int, shard int").parquet(path)
    return stored.filter(F.col("shard").isin([r[0] for r in wanted.collect()]) & F.col("token").isin(tokens)).drop("shard")


def terms(symbols: DataFrame, query: str, limit: int = 100, index: str | None = None) -> DataFrame:
    """Definitions that hold any of the query's tokens, scored by coverage: (value, definition_id, score).

    Postings come from a stored index where its path is given."""
    wanted = query_tokens(query)
    found = read_term_index(symbols.sparkSession, index, wanted) if index else postings(symbols).filter(F.col("token").isin(wanted))
    count = lambda bit: F.sum((F.col("fields").bitwiseAND(bit) > 0).cast("int"))
    per = found.groupBy("id", "name").agg(F.count("*").alias("m"), *[count(bit).alias(c) for c, bit in (("n", 1), ("q", 2), ("p", 4), ("k", 8))])
    part = lambda c, most, points: F.least(F.col(c), F.lit(most)) * points
    score = F.lit(600_000) + part("m", 6, 35_000) + part("n", 4, 25_000) + part("q", 4, 10_000) + part("p", 4, 3_000) + part("k", 2, 1_000) + F.when(F.col("m") == len(wanted), 20_000).otherwise(0)
    hits = per.select(F.col("name").alias("value"), F.col("id").alias("definition_id"), F.least(score, F.lit(950_000)).cast("int").alias("score"))
    return hits.orderBy(F.col("score").desc(), "value", "definition_id").limit(limit)


def resolve_names(symbols: DataFrame, names: DataFrame, scope: str | None = None, shown: int = 10, nodes: DataFrame | None = None) -> DataFrame:
    """For each of names (query): (query, outcome, id, definitions_total, candidates).

    Ids and qualified names go before short names; a name that is a node of the graph (nodes: node), but no symbol's id, is
    that node. Without scope one definition resolves; with a scope (a part of the
    path) the definitions in it are counted. Outcomes: resolved, ambiguous, not_in_scope, no_symbol_named."""
    scope = (scope or "").strip() or None
    tiers = F.array(F.struct(F.lit(0).alias("tier"), F.col("id").alias("key")), F.struct(F.lit(0).alias("tier"), F.col("qualified").alias("key")), F.struct(F.lit(1).alias("tier"), F.col("name").alias("key")))
    keyed = symbols.select("id", "name", "path", F.explode(F.array_distinct(tiers)).alias("t")).select("id", "name", "path", "t.tier", "t.key").distinct()
    if nodes is not None:
        literal = nodes.select(F.col("node").alias("id")).distinct().join(symbols.select("id"), "id", "left_anti")
        keyed = keyed.unionByName(literal.select("id", F.col("id").alias("name"), F.col("id").alias("path"), F.lit(-1).alias("tier"), F.col("id").alias("key")))
    hits = names.select("query").distinct().join(keyed, F.col("query") == F.col("key"), "left")
    inside = F.col("path").contains(scope) if scope else F.lit(True)
    best = hits.withColumn("_in", F.col("id").isNotNull() & inside)
    tier = F.min(F.when(F.col("_in"), F.col("tier"))).over(Window.partitionBy("query"))
    fallback = F.min("tier").over(Window.partitionBy("query"))
    best = best.withColumn("_tier", F.coalesce(tier, fallback)).filter("_tier is null or tier = _tier")
    place = F.row_number().over(Window.partitionBy("query", "_in").orderBy("name", "path", "id"))
    best = best.withColumn("_at", place)
    out = best.groupBy("query").agg(
        F.count("id").alias("definitions_total"),
        F.sum(F.col("_in").cast("int")).alias("_n"),
        F.min(F.when(F.col("_in") & (F.col("_at") == 1), F.col("id"))).alias("_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("_in") | F.lit(scope is not None)) & (F.col("_at") <= shown), F.struct("name", "path", "id")))), lambda x: x["id"]), "|").alias("_ids"),
    )
    outcome = F.when(F.col("definitions_total") == 0, "no_symbol_named").when(F.col("_n") == 0, "not_in_scope").when(F.col("_n") == 1, "resolved").otherwise("ambiguous")
    return out.select("query", outcome.alias("outcome"), F.when(outcome == "resolved", F.col("_id")).alias("id"), "definitions_total", F.when(outcome.isin("ambiguous", "not_in_scope"), F.col("_ids")).otherwise("").alias("candidates"))


def explore_rank(symbols: DataFrame, edges: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Prefix and term hits together: term scores grow with a definition's relations (40 at most count), and term hits
    far below the best are dropped."""
    found = terms(symbols, query, max(16 * limit, 128))
    relations = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).groupBy("id").agg(F.count("*").alias("sites"))
    boosted = found.join(relations, found.definition_id == relations.id, "left").select("value", "definition_id", F.least(F.col("score") + F.least(F.coalesce("sites", F.lit(0)), F.lit(40)) * 500, F.lit(999_999)).cast("int").alias("score"))
    kept = boosted.withColumn("_best", F.max("score").over(Window.partitionBy())).filter("score >= _best - 50000").drop("_best").withColumn("reason", F.lit("term-coverage"))
    first = prefix(symbols, query, limit + 1).select("value", F.lit(None).cast("string").alias("definition_id"), "score", "reason")
    return first.unionByName(kept).orderBy(F.col("score").desc(), "value", "definition_id").limit(limit)


def find(symbols: DataFrame, query: str, mode: str = "auto", limit: int = 100) -> DataFrame:
    """(value, definition_id, score, reason) of a search by its mode: exact, prefix, fuzzy, regex, terms, or auto, the first
    of exact, prefix, terms and fuzzy that finds anything. The limit is held between 1 and 1000."""
    limit = max(1, min(limit, 1000))
    none = F.lit(None).cast("string").alias("definition_id")
    plain = lambda f: lambda: f(symbols, query, limit).select("value", none, "score", "reason")
    modes = {"exact": plain(exact), "prefix": plain(prefix), "fuzzy": plain(fuzzy), "regex": plain(regex), "terms": lambda: terms(symbols, query, limit).withColumn("reason", F.lit("term-coverage"))}
    if mode != "auto":
        if mode not in modes:
            raise ValueError(f"no such mode: {mode}")
        return modes[mode]()
    for name in ("exact", "prefix", "terms"):
        found = modes[name]()
        if not found.isEmpty():
            return found
    return modes["fuzzy"]()


def explore(symbols: DataFrame, edges: DataFrame, query: str, limit: int = 10, relations: int = 20) -> DataFrame:
    """The best definition for a query and what stands around it: (part, position, node, kind, depth, risk).

    Parts: ``primary``, the highest definition of ``explore_rank`` (of a name, the least id); ``candidate``, the others;
    ``caller`` and ``callee``, its first relations in display order; ``impact``, the riskiest that depend on it."""
    from . import graph

    ranked = explore_rank(symbols, edges, query, limit)
    named = symbols.groupBy(F.col("name").alias("value")).agg(F.min("id").alias("_id"))
    order = [F.col("score").desc(), F.col("value"), F.col("definition_id")]
    hits = ranked.join(named, "value", "left").withColumn("node", F.coalesce("definition_id", "_id")).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    hits = hits.select("node", "position", F.col("reason").alias("kind"))
    first = hits.orderBy("position").limit(1).collect()
    empty = lambda df: df.select("part", "position", "node", F.col("kind"), F.col("depth").cast("int").alias("depth"), F.col("risk").cast("string").alias("risk"))
    none = {"depth": F.lit(None), "risk": F.lit(None)}
    out = empty(hits.withColumn("part", F.when(F.col("position") == 1, "primary").otherwise("candidate")).withColumns(none))
    if not first or first[0]["node"] is None:
        return out
    primary = first[0]["node"]
    for part, reverse, end in (("caller", True, "src"), ("callee", False, "dst")):
        found = graph.sites(edges, primary, reverse, limit=relations)
        out = out.unionByName(empty(found.select(F.lit(part).alias("part"), "position", F.col(end).alias("node"), "kind").withColumns(none)))
    start = symbols.sparkSession.createDataFrame([(primary,)], "node string")
    hurt = graph.impact(edges, start, graph.Limits(depth=4)).orderBy(F.col("score").desc(), "depth", "symbol").limit(relations)
    at = F.row_number().over(Window.orderBy(F.col("score").desc(), "depth", "symbol"))
    return out.unionByName(empty(hurt.select(F.lit("impact").alias("part"), at.alias("position"), F.col("symbol").alias("node"), F.lit(None).cast("string").alias("kind"), "depth", "risk")))
