"""Personal data: fixed patterns and bootstrapped contextual extraction (operator 2).

The base finds e-mail addresses, IP addresses, card and phone numbers by their form. These seed
entities then teach where personal data stands: the words before an entity are a pattern.
Patterns and instances (entities, and candidates of unknown form) make up a graph. Candidates are
runs of tokens with digits, spaced, bracketed or in one piece, for every kind, and addresses in
other at-forms, with or without digits, for e-mail alone. In each
iteration a pattern's confidence is the score of its instances over their number, held back
where few different seeds support it, and an instance's score is the highest confidence of a
pattern that it occurs with. Instances that reach the confidence to extract are seeds of the
next iteration, so words that only ever precede discovered identifiers become patterns too.
What is learned over more steps is less sure, as each step multiplies by a confidence below one.
Instances that occur after patterns of high confidence are found
as well, under the kind of entity that taught the pattern.

Everything is DataFrame functions. Texts are read once; what follows works on the entities and
on the candidate identifiers only. Edges are counted by pattern and instance before any
shuffle by pattern, so copies of a text, or one very common pattern, leave a task as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skumetry.llm.shared import stored

KINDS = ("email", "ip", "card", "phone")

# The base patterns, for Java. Each finds what its plain form finds, leftmost and
# non-overlapping: greedy runs that nothing after them could shorten are possessive, and a run
# is entered only at its first character or where the last match ended, so that long runs take
# linear time and no stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?+[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

# A token holds a digit; its joints are within it. Tokens are joined by a space, brackets, a dash,
# a slash or a spaced dot, and a plain word ends the run; a few capitals may stand between digits.
_TOKEN = r"(?=[A-Za-z._@-]*+[0-9])[A-Za-z0-9](?:[._@-]?+[A-Za-z0-9])*+(?![A-Za-z0-9@_])"
_SPACE = "[  ]"
_JOINT = rf"[)\]]?(?:{_SPACE}?[-–/]{_SPACE}?|{_SPACE}\.{_SPACE}|{_SPACE}?[(\[]|{_SPACE}|(?<=[)\]]))"
#: An identifier of unknown form: a run of tokens, with at least four digits and six letters or digits.
CANDIDATE = rf"(?<![A-Za-z0-9@._%+-])\+?[(\[]?{_TOKEN}(?:{_JOINT}(?:[A-Z]{{1,4}}{_SPACE}(?=[0-9]))?{_TOKEN})*+"

_AT = r"(?i:at|ät|arroba|arobase|@)"
_DOT = rf"(?:\.| \. (?=\p{{Ll}})| ?[(\[{{<] ?(?i:dot|punkt|point|punto|\.) ?[)\]}}>] ?| (?i:dot|punkt|point|punto) )"
#: An e-mail address of unknown form: any mark for at; an at between blanks asks for a dot after it.
#: The part before the mark ends where a joint, "at" and a joint follow.
MAIL = (
    r"(?<![\p{L}0-9._%+-])[\p{L}0-9%+]++(?:(?![_-](?i:at)[_-])[._-][\p{L}0-9%+]++)*+"
    rf"(?:(?: ?@ ?| ?[(\[{{<] ?{_AT} ?[)\]}}>] ?)[\p{{L}}0-9-]++(?:{_DOT}[\p{{L}}0-9-]++)*+"
    rf"|[ _-](?i:at)[ _-][\p{{L}}0-9-]++(?:{_DOT}[\p{{L}}0-9-]++)++)"
)

#: Words of context before an entity, and how many of its characters are looked at.
CONTEXT = 48
ITERATIONS = 3
#: Different seed identifiers that a pattern needs at least, and the confidence to extract.
MIN_SEEDS = 5
MIN_CONFIDENCE = 0.6
#: What a pattern's number of instances is raised by when its confidence is computed.
HELD_BACK = 1.0


def _matches(text: Column, pattern: str, likely: Column) -> Column:
    """Every match as ``begin`` (code points), ``token`` and ``left``, the end of the text before it.

    Texts that cannot hold a match, by the cheap test ``likely``, are not searched.
    """
    none = F.array().cast("array<struct<begin:int,token:string,left:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("token"), F.slice(between, 1, F.size(between) - 1).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("before"), none.alias("out"))

    def place(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        left = F.right(F.concat(acc["before"], x["gap"]), F.lit(CONTEXT))
        return F.struct(
            (begin + F.length(x["token"])).alias("at"),
            F.right(F.concat(left, x["token"]), F.lit(CONTEXT)).alias("before"),
            F.concat(acc["out"], F.array(F.struct(begin.alias("begin"), x["token"].alias("token"), left.alias("left")))).alias("out"),
        )

    placed = F.aggregate(pairs, start, place, lambda acc: acc["out"])
    return F.when(likely, placed).otherwise(none)


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def _is_run(token: Column) -> Column:
    """Whether a candidate may be of any kind; others may be e-mail addresses only."""
    return token.rlike(f"^(?:{CANDIDATE})$") & (F.length(_digits(token)) >= 4) & (F.length(F.regexp_replace(token, "[^A-Za-z0-9]", "")) >= 6)


def _passes_luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    every = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.lit(0)))
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(F.lit(0)))
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)
    return (add(every) + add(doubled)) % 10 == 0


def _valid(kind: str, token: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(token, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("00"), p), F.lit(3)).cast("int") <= 255))
    size = F.length(_digits(token))
    if kind == "card":
        return size.between(13, 19) & _passes_luhn(_digits(token))
    if kind == "phone":
        return size.between(9, 15)
    return F.lit(True)


def _spans(found: Column, kind: str) -> Column:
    """Valid matches as ``kind``, ``begin``, ``end``, ``token`` and ``left``."""
    return F.transform(
        F.filter(found, lambda m: _valid(kind, m["token"])),
        lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["begin"].alias("begin"), (m["begin"] + F.length(m["token"])).alias("end"), m["token"].alias("token"), m["left"].alias("left")),
    )


def find_entities(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with ``base`` (entities) and ``others`` (candidates).

    Both are arrays of ``kind`` (its place in ``KINDS``; null for candidates), ``begin``,
    ``end`` (code points, end exclusive), ``token`` and ``left``, the text before.
    """
    text = F.coalesce("text", F.lit(""))
    likely = {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
        "phone": text.contains("+"),
    }
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    keep = [c for c in docs.columns if c not in ("text", "base", "others")]
    base = F.concat(*[_spans(_matches(text, pattern[k], likely[k]), k) for k in KINDS])
    runs = F.filter(_matches(text, CANDIDATE, text.rlike("[0-9]")), lambda m: _is_run(m["token"]))
    mails = F.filter(_matches(text, MAIL, text.rlike(rf"@|[(\[{{<] ?{_AT} ?[)\]}}>]|[ _-](?i:at)[ _-]")), lambda m: ~_is_run(m["token"]))
    others = F.transform(
        F.concat(runs, mails),
        lambda m: F.struct(F.lit(None).cast("int").alias("kind"), m["begin"].alias("begin"), (m["begin"] + F.length(m["token"])).alias("end"), m["token"].alias("token"), m["left"].alias("left")),
    )
    found = docs.select(*[F.col(f"`{c}`") for c in keep], base.alias("base"), others.alias("others"))
    apart = F.filter("others", lambda o: ~F.exists("base", lambda b: (b["begin"] < o["end"]) & (o["begin"] < b["end"])))
    return found.withColumn("others", apart)


def _pattern(left: Column) -> Column:
    """The last two words before an entity, lower case, every digit as 0; null without one."""
    words = F.filter(F.split(F.lower(left), r"[ \t-\r]+"), lambda w: w != "")
    return F.nullif(F.concat_ws(" ", F.slice(F.reverse(F.transform(words, lambda w: F.regexp_replace(w, "[0-9]", "0"))), 1, 2)), F.lit(""))


def _mail_only(entity: str) -> Column:
    return F.col(f"{entity}.kind").isNull() & ~_is_run(F.col(f"{entity}.token"))


def pattern_confidences(found: DataFrame, iterations: int = ITERATIONS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``pattern``, ``kind``, ``confidence``: how surely a pattern precedes a kind of entity.

    A pattern needs ``MIN_SEEDS`` different seeds of the kind: base entities, and from the second
    iteration on candidates whose score reached ``min_confidence`` in the one before.
    """
    entity, is_mail = F.explode(F.concat("base", "others")), F.col("kind") == KINDS.index("email")
    edges = stored(
        found.select(entity.alias("e")).select(_pattern(F.col("e.left")).alias("pattern"), F.col("e.token").alias("instance"), F.col("e.kind").alias("kind"), _mail_only("e").alias("mail"))
        .where("pattern is not null").distinct()
    )
    total = stored(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("every"), F.count_if("mail").alias("mails")))
    base = stored(edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("entities")))
    candidates = edges.where("kind is null").select("pattern", "instance", "mail")
    instances = F.col("every") - F.when(is_mail, 0).otherwise(F.col("mails"))
    support = base.select("*", F.lit(0.0).alias("gained"), F.lit(0).alias("discovered"))
    for step in range(iterations):
        if step:
            reached = candidates.join(scores, "instance").where(~F.col("mail") | is_mail)  # noqa: F821
            gained = reached.groupBy("pattern", "kind").agg(F.sum("score").alias("gained"), F.count_if(F.col("score") >= min_confidence).alias("discovered"))
            support = base.join(gained, ["pattern", "kind"], "full")
        none = {"entities": 0, "gained": 0.0, "discovered": 0}
        seeded = support.fillna(none).where(F.col("entities") + F.col("discovered") >= MIN_SEEDS)
        confident = stored(
            seeded.join(total, "pattern").select("pattern", "kind", ((F.col("entities") + F.col("gained")) / (instances + HELD_BACK)).alias("confidence"))
        )
        if step + 1 < iterations:
            scores = stored(candidates.join(confident, "pattern").where(~F.col("mail") | is_mail).groupBy("instance", "kind").agg(F.max("confidence").alias("score")))
    return confident


def extract(docs: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``docs`` without its text, with ``base`` and ``found``, arrays of ``kind``, ``begin``, ``end``.

    ``found`` are the entities that context alone gives away. They overlap no base entity. Null
    and empty texts have neither. Repeated rows and null ids are kept; columns of ``docs`` named
    ``base`` or ``found`` are replaced, all others are kept.
    """
    keep = [c for c in docs.columns if c not in ("text", "base", "found")]
    own = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    entities = stored(find_entities(docs.select(*own, "text", F.xxhash64("text").alias("_row"))))
    confident = pattern_confidences(entities, min_confidence=min_confidence).where(F.col("confidence") >= min_confidence)
    best = confident.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind")).withColumn("mail", F.lit(False))
    best = best.unionByName(confident.where(F.col("kind") == KINDS.index("email")).select("pattern", "kind", F.lit(True).alias("mail")))
    # Texts are told apart by their hash and their candidates, so equal texts are searched once.
    one = entities.where(F.size("others") > 0).select("_row", F.explode("others").alias("o")).select(
        "_row", "o.begin", "o.end", _pattern(F.col("o.left")).alias("pattern"), _mail_only("o").alias("mail")
    ).distinct()
    # A run and an address that begin together are one entity, the longer.
    longest = one.join(best, ["pattern", "mail"]).groupBy("_row", "kind", "begin").agg(F.max("end").alias("end"))
    hits = longest.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("kind", "begin", "end"))).alias("found"))
    plain = F.transform("base", lambda b: F.struct(b["kind"], b["begin"], b["end"]))
    none = F.array().cast("array<struct<kind:int,begin:int,end:int>>")
    return (
        entities.join(stored(hits), "_row", "left")
        .select(*[F.col(f"row.`{c}`") for c in keep], plain.alias("base"), F.coalesce("found", none).alias("found"))
    )


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end`` by kind and start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["begin"], s["end"])), ",")


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``base`` and ``found`` in its text replaced by ``[KIND]``.

    Where spans overlap, all that they cover is replaced by the kind of the one that begins first,
    and of those the longest. ``base`` and ``found`` are dropped.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    spans = F.array_sort(
        F.transform(F.concat("base", "found"), lambda s: F.struct(s["begin"].alias("begin"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind")))
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    pieces = F.aggregate(
        spans,
        start,
        lambda acc, s: F.when(s["begin"] < acc["at"], F.struct(F.greatest(acc["at"], -s["minus_end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct((-s["minus_end"]).alias("at"), F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"] + 1, s["begin"] - acc["at"]), names[s["kind"]])).alias("out"))
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    text = F.when(F.size(spans) == 0, F.col("text")).otherwise(pieces)
    return docs.withColumn("text", text).drop("base", "found")


def without_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with all personal data in ``text`` masked; all rows and columns stay.

    A column ``n_chars`` is set to the new length. Null texts stay null.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    masks = masked(extract(rows).withColumn("text", F.col("row.text")))
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")}
    return masks.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
