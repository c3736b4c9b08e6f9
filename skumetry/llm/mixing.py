"""Mixing sources to target weights by hierarchical budgeting (operator 3).

Sources are the leaves of a tree of domains, languages and sources. A token budget goes down the
tree by weights. A node cannot take more than its leaves hold in ``max_epochs`` epochs; what it
lacks goes to its siblings, by their weights, and only what all of them together cannot take
goes to the siblings of their parent. Each leaf then takes a prefix, of as many tokens as it was
given, from a sequence of epochs, each of which is a seeded order of all its documents.

Budgets are whole tokens: shares are rounded down, so a budget falls short by less than one
token for each node. A document counts as taken if the prefix reaches its first token.

No leaf is ever sorted in one task. Order keys are hashes, so equal ranges of hash values hold
about equal numbers of documents; sums over such ranges tell where the prefix of a leaf ends,
and only the documents of that one range are looked at one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skumetry.llm.shared import stored

SEED = 20240607
MAX_EPOCHS = 2
#: The budget in hundredths of the tokens of the input.
BUDGET_PERCENT = 100
#: Weights of domains and languages; others, and all sources, weigh 1.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
#: Documents in a range of hash values, about.
RANGE_DOCUMENTS = 2048
#: Leaves up to which their table (under 300 bytes a row) is broadcast; more are joined with salt.
BROADCAST_LEAVES = 50_000
SALTS = 64

LEAF = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The domain of a source: the last two bits of the number it ends with, ``other`` without one."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("d"), (F.nullif(number, F.lit("")).cast("int") % 4).cast("string")))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for key, value in weights.items():
        out = F.when(name == key, value).otherwise(out)
    return out.cast("decimal(38,0)")


def _whole(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def share_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``children`` with ``target``: each parent's ``budget`` shared by ``weight`` within ``capacity``.

    Children are filled in the order of capacity by weight: one is full if its share of what
    the fuller ones leave is no less than its capacity.
    """
    group = W.partitionBy(*parent)
    before = group.orderBy(F.col("capacity") / F.col("weight"), child).rowsBetween(W.unboundedPreceding, -1)
    nought = F.lit(0).cast("decimal(38,0)")
    rest_weight = F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), nought)
    rest_budget = _whole("budget") - F.coalesce(F.sum("capacity").over(before), nought)
    full = children.withColumn("full", _whole("capacity") * rest_weight.cast("decimal(38,0)") <= F.col("weight") * rest_budget.cast("decimal(38,0)"))
    left_budget = _whole("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(nought)).over(group)
    left_weight = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(nought)).over(group)
    shared = full.withColumn("left_budget", left_budget.cast("decimal(38,0)")).withColumn("left_weight", left_weight.cast("decimal(38,0)"))
    part = F.expr("cast(weight * left_budget as decimal(38,0)) div nullif(left_weight, 0)")
    return shared.withColumn("target", F.when(F.col("full"), F.col("capacity")).otherwise(part).cast("long")).drop("full", "left_budget", "left_weight")


def leaf_targets(
    leaves: DataFrame, budget_percent: int, max_epochs: int, domain_weights: dict[str, int], language_weights: dict[str, int]
) -> DataFrame:
    """The leaves (``tokens``) with the tokens that each is to give (``target``)."""
    held = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast("decimal(38,0)"))
    languages = held.groupBy("domain", "lang").agg(F.sum("capacity").cast("decimal(38,0)").alias("capacity"))
    domains = languages.groupBy("domain").agg(F.sum("capacity").cast("decimal(38,0)").alias("capacity"))
    root = leaves.agg(F.expr(f"sum(tokens) * {budget_percent} div 100").alias("budget"))
    given = share_out(domains.crossJoin(F.broadcast(root)).withColumn("root", F.lit(0)).withColumn("weight", _weight(F.col("domain"), domain_weights)), ["root"], "domain")
    given = languages.join(given.select("domain", F.col("target").alias("budget")), "domain").withColumn("weight", _weight(F.col("lang"), language_weights))
    given = share_out(given, ["domain"], "lang")
    given = held.join(given.select("domain", "lang", F.col("target").alias("budget")), ["domain", "lang"]).withColumn("weight", F.lit(1).cast("decimal(38,0)"))
    return share_out(given, ["domain", "lang"], "source").select(*LEAF, "documents", "tokens", "target")


def _hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(doc_id.cast("string"), F.lit(""))))


def _key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The order key of a document in an epoch. Equal keys are taken together."""
    return F.concat(_hash(seed, epoch, doc_id), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))


def _cuts(sizes: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """For each leaf the whole epochs and the last order key of the part of one (null: none)."""
    plan = targets.where("target > 0").select(
        *LEAF, F.expr("target div tokens").alias("epochs"), (F.col("target") % F.col("tokens")).alias("quota"),
        (F.col("documents") / RANGE_DOCUMENTS + 1).cast("long").alias("ranges"),
    )
    plan = stored(plan)
    partial = plan.where("quota > 0")
    keyed = _with_leaf(sizes.where("n_tokens > 0"), partial, "inner").withColumn("key", _key(seed, F.col("epochs") + 1, F.col("doc_id")))
    keyed = keyed.withColumn("range", F.expr("(conv(substr(key, 1, 8), 16, 10)::bigint * ranges) div 4294967296"))
    keyed = stored(keyed.select(*LEAF, "range", "key", "quota", "n_tokens"))
    sums = keyed.groupBy(*LEAF, "range", "quota").agg(F.sum("n_tokens").alias("held"))
    before = F.coalesce(F.sum("held").over(W.partitionBy(*LEAF).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("before", before).where("before < quota and before + held >= quota").select(*LEAF, "range", "before")
    here = keyed.join(ends, [*LEAF, "range"]).groupBy(*LEAF, "key", "quota", "before").agg(F.sum("n_tokens").alias("own"))
    running = F.coalesce(F.sum("own").over(W.partitionBy(*LEAF).orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = here.withColumn("running", F.col("before") + running).where("running < quota").groupBy(*LEAF).agg(F.max("key").alias("last_key"))
    return stored(plan.select(*LEAF, "epochs").join(last, list(LEAF), "left"))


def _with_leaf(rows: DataFrame, leaves: DataFrame, how: str) -> DataFrame:
    """``rows`` joined to the table of leaves, whose size decides how."""
    if leaves.count() <= BROADCAST_LEAVES:
        return rows.join(F.broadcast(leaves), list(LEAF), how)
    salted = leaves.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, [*LEAF, "_salt"], how).drop("_salt")


def mix_sources(
    docs: DataFrame,
    tokens: Column | None = None,
    budget_percent: int = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    domain_weights: dict[str, int] = DOMAIN_WEIGHTS,
    language_weights: dict[str, int] = LANGUAGE_WEIGHTS,
) -> DataFrame:
    """The rows of ``docs`` in the mix, one for each ``epoch`` (from 1) in which a row is taken.

    ``tokens`` counts a document's tokens, by default the words of ``text``. Documents without
    tokens are never taken. A null language or source is a leaf of its own. Rows that share
    their leaf and ``doc_id``, null included, are taken together. Other columns are kept;
    a column named ``epoch`` is replaced. An empty table gives an empty mix.
    """
    leaf = [
        domain_of(F.coalesce("source", F.lit(""))).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
    ]
    counted = (word_count(F.col("text")) if tokens is None else tokens).cast("long").alias("n_tokens")
    sizes = stored(docs.select("doc_id", *leaf, counted))
    leaves = stored(sizes.groupBy(*LEAF).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    cuts = _cuts(sizes, leaf_targets(leaves, budget_percent, max_epochs, domain_weights, language_weights), seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "epoch"]).alias("row")
    rows = _with_leaf(docs.select(row, "doc_id", *leaf, counted).where("n_tokens > 0"), cuts, "inner")
    taken = F.col("epochs") + F.when(_key(seed, F.col("epochs") + 1, F.col("doc_id")) <= F.col("last_key"), 1).otherwise(0)
    rows = rows.withColumn("taken", taken).where("taken > 0")
    return rows.select("row.*", F.explode(F.sequence(F.lit(1), F.col("taken").cast("int"))).alias("epoch"))


def _case(column: str, weights: dict[str, int]) -> str:
    return f"(CASE {column} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())} ELSE 1 END)::HUGEINT"


def _share_sql(children: str, parent: str, child: str) -> str:
    """The same sharing in DuckDB SQL."""
    return f"""
        SELECT *, CASE WHEN filled THEN capacity ELSE weight * (budget - coalesce(sum(capacity) FILTER (filled) OVER (PARTITION BY {parent}), 0)::HUGEINT)
            // nullif(coalesce(sum(weight) FILTER (NOT filled) OVER (PARTITION BY {parent}), 0)::HUGEINT, 0) END AS target
        FROM (
            SELECT *, capacity * (sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER before, 0))::HUGEINT
                <= weight * (budget - coalesce(sum(capacity) OVER before, 0))::HUGEINT AS filled
            FROM ({children})
            WINDOW before AS (PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight::DOUBLE, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        )"""


def mix_sql(documents: str, columns: str) -> str:
    """DuckDB SQL of the mix of a relation, with the default parameters; ``columns`` are selected from it.

    The relation may have any columns beside ``doc_id``, ``text``, ``lang`` and ``source``.
    """
    domains = _share_sql(f"SELECT *, 0 AS root, {_case('domain', DOMAIN_WEIGHTS)} AS weight FROM mix_domains, mix_budget", "root", "domain")
    languages = _share_sql(
        f"SELECT l.*, d.target AS budget, {_case('l.lang', LANGUAGE_WEIGHTS)} AS weight FROM mix_languages l JOIN mix_domain_targets d USING (domain)", "domain", "lang"
    )
    sources = _share_sql(
        "SELECT l.*, t.target AS budget, 1::HUGEINT AS weight FROM mix_leaves l JOIN mix_language_targets t USING (domain, lang)", "domain, lang", "source"
    )
    return f"""
    WITH mix_docs AS (
        SELECT *, coalesce(lang, '') AS leaf_lang, coalesce(source, '') AS leaf_source,
            CASE WHEN regexp_matches(coalesce(source, ''), '[0-9]+$')
                THEN 'd' || (right(regexp_extract(source, '([0-9]+)$', 1), 9)::INTEGER % 4) ELSE 'other' END AS domain,
            coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS mix_tokens
        FROM ({documents})
    ), mix_leaves AS (
        SELECT domain, leaf_lang AS lang, leaf_source AS source, sum(mix_tokens)::BIGINT AS tokens, (sum(mix_tokens) * {MAX_EPOCHS})::HUGEINT AS capacity
        FROM mix_docs GROUP BY ALL HAVING sum(mix_tokens) > 0
    ), mix_languages AS (SELECT domain, lang, sum(capacity)::HUGEINT AS capacity FROM mix_leaves GROUP BY ALL
    ), mix_domains AS (SELECT domain, sum(capacity)::HUGEINT AS capacity FROM mix_languages GROUP BY ALL
    ), mix_budget AS (SELECT (sum(tokens) * {BUDGET_PERCENT})::HUGEINT // 100 AS budget FROM mix_leaves
    ), mix_domain_targets AS ({domains}
    ), mix_language_targets AS ({languages}
    ), mix_targets AS ({sources}
    ), mix_plan AS (
        SELECT domain, lang, source, (target // tokens)::BIGINT AS epochs, (target % tokens)::BIGINT AS quota FROM mix_targets WHERE target > 0
    ), mix_keys AS (
        SELECT d.*, p.epochs, p.quota,
            md5('{SEED}:' || (p.epochs + 1) || ':' || coalesce(d.doc_id::VARCHAR, '')) || ':' || coalesce(d.doc_id::VARCHAR, '') AS mix_key
        FROM mix_docs d JOIN mix_plan p ON p.domain = d.domain AND p.lang = d.leaf_lang AND p.source = d.leaf_source
        WHERE d.mix_tokens > 0
    ), mix_taken AS (
        SELECT *, epochs + CASE WHEN coalesce(sum(mix_tokens) OVER (
            PARTITION BY domain, leaf_lang, leaf_source ORDER BY mix_key GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < quota THEN 1 ELSE 0 END AS taken
        FROM mix_keys
    )
    SELECT {columns} FROM (SELECT *, unnest(range(1, taken + 1))::INTEGER AS epoch FROM mix_taken WHERE taken > 0)"""
