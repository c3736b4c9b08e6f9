from __future__ import annotations

import hashlib
import random
import re

from skumetry.llm import pii, queries

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [2 * d - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def brute(text):
    out = []
    for kind in pii.KINDS:
        for m in PLAIN[kind].finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def random_text(rng):
    parts = ["a@b.c_d@e.f", "x@y", "u.v+w@mail-1.example.com", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "007.010.0255.1", "1.2.3",
             "4539578763621486", "4539 5787-6362 1486", "4111111111111111", "1234567890123456", "12345 - 678", "+1 (743) 555-3824", "+1 2", "+49.30.1234567 ",
             "é", "😀", " ", "  ", "\n", "word", "-", "+", "@", ".", "Ω", "77", "+()", "0" * 25]
    return "".join(rng.choice(parts) + rng.choice(["", "", " ", "\t"]) for _ in range(rng.randint(0, 30)))


def rows():
    rng = random.Random(9)
    out = [(i, random_text(rng)) for i in range(800)]
    out += [(900, None), (901, ""), (902, "a." * 40_000 + "@" + "b." * 40_000 + "c"), (903, "1-" * 50_000), (904, "+" + "1 " * 50_000)]
    return out + [(1, out[1][1]), (None, "me@x.org")]


def test_base_equals_the_plain_patterns(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows()], "doc_id long, text string, base string")
    found = pii.extract(docs)
    got = sorted(((r.doc_id, [(pii.KINDS[s.kind], s.begin, s.end) for s in r.base]) for r in found.collect()), key=str)
    assert got == sorted(((i, brute(t)) for i, t in rows()), key=str)


def planted():
    """Accounts are written in a form that no base pattern knows, after words that precede cards."""
    rng = random.Random(1)
    noise = lambda n: " ".join(rng.choice(["lo", "mi", "ta", "ru", "sen", "vo"]) for _ in range(n))
    out = []
    for i in range(20):
        out.append((i, f"{noise(9)} charged to card 4539578763621486 {noise(3)} mail me at user{i}@example.org {noise(4)}"))
    stems = [str(453957876362100 + 7 * i) for i in range(8)]
    cards = [next(x + str(d) for d in range(10) if luhn(x + str(d))) for x in stems]
    out = [(i, t.replace("4539578763621486", cards[i % 8])) for i, t in out]
    out.append((50, f"{noise(5)} charged to card AB99-1234-XY {noise(2)}"))
    out.append((51, f"{noise(5)} order number is AB99-9999-XY {noise(2)}"))
    return out


def test_patterns_find_unseen_identifiers(spark):
    docs = spark.createDataFrame(planted(), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.extract(docs).collect()}
    text = dict(planted())[50]
    at = text.index("AB99")
    assert [(s.kind, s.begin, s.end) for s in found[50].found] == [(pii.KINDS.index("card"), at, at + len("AB99-1234-XY"))]
    assert not found[51].found and not any(found[i].found for i in range(20))
    masked = {r.doc_id: r.text for r in pii.masked(pii.extract(docs).join(docs, "doc_id")).collect()}
    assert "charged to card [CARD] " in masked[50] and "charged to card [CARD] " in masked[3] and "at [EMAIL] " in masked[3]
    assert masked[51] == dict(planted())[51]


def test_query_columns(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_bootstrapped_pii(spark, str(tmp_path)).where("doc_id = 7").first()
    base = brute(dict(rows())[7])
    listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
    assert got.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and got.spans.startswith(listed[:5])
    assert [got[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]


def test_no_documents(spark):
    assert pii.extract(spark.createDataFrame([], "doc_id long, text string")).count() == 0


FORMS = {
    "card": ["4539 5787 6362 1487", "AB-123456", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "[4539]-5787-6362"],
    "phone": ["030 123 4567", "(030) 1234567", "030 / 123 45 67", "030-123-4567", "030 (123) 4567", "030.123.4567"],
    "email": ["anna(at)firma.de", "anna.b [at] firma [dot] de", "anna at firma dot de", "anna @ firma.de", "anna_at_firma.de", "änne{at}firma.de", "anna77(at)firma.de"],
}


def test_patterns_find_spaced_bracketed_and_digit_free_forms(spark):
    before = {"card": "charged to card", "phone": "please call line", "email": "write mail under"}
    rows = [(i, t) for i, t in planted() if i < 20]
    rows += [(100 + i, f"lo mi please call line +49 30 55512{i:02d} ta") for i in range(20)]
    rows += [(200 + i, f"lo mi write mail under user{i}@example.org ta") for i in range(30)]
    planned = {300 + i: x for i, x in enumerate((k, f) for k in FORMS for f in FORMS[k])}
    rows += [(i, f"lo mi {before[k]} {f} ta ru sen") for i, (k, f) in planned.items()]
    rows += [(400, "lo charged to card anna(at)firma.de ta"), (401, "lo order number is (030) 1234567 ta"), (402, "lo charged to card well-known ta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(pii.KINDS[s.kind], s.begin, s.end) for s in r.found] for r in pii.extract(docs).collect()}
    text = dict(rows)
    for i, (kind, form) in planned.items():
        at = text[i].index(form)
        assert found[i] == [(kind, at, at + len(form))], (form, found[i])
    assert not any(found[i] for i in found if i not in planned)


def test_overlapping_spans_are_masked_to_the_last_end(spark):
    rows = [(1, "at 10.0.0.0 4539578763621486 it"), (2, "at 10.0.0.0 or 4539578763621486 it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.masked(pii.extract(docs).join(docs, "doc_id")).collect()}
    assert got == {1: "at [IP] it", 2: "at [IP] or [CARD] it"}


def brute_confidences(edges, iterations=pii.ITERATIONS, least=pii.MIN_CONFIDENCE):
    """``edges`` are different (pattern, instance, kind or None, whether it may be e-mail only)."""
    fits = lambda kind, mail: kind == 0 or not mail
    scores, confident = {}, {}
    for _ in range(iterations):
        confident = {}
        for p in {e[0] for e in edges}:
            own = [e for e in edges if e[0] == p]
            for kind in range(len(pii.KINDS)):
                known = sum(e[2] == kind for e in own)
                reached = [scores[e[1], kind] for e in own if e[2] is None and fits(kind, e[3]) and (e[1], kind) in scores]
                if known + sum(x >= least for x in reached) >= pii.MIN_SEEDS:
                    confident[p, kind] = (known + sum(reached)) / (sum(fits(kind, e[3]) for e in own) + pii.HELD_BACK)
        scores = {}
        for p, instance, kind, mail in edges:
            for (q, k), c in confident.items():
                if kind is None and q == p and fits(k, mail):
                    scores[instance, k] = max(scores.get((instance, k), 0.0), c)
    return confident


def test_confidences_equal_a_plain_graph(spark):
    rng = random.Random(12)
    words = ["card", "call", "ref", "mail", "konto", "acct"]
    known = {0: [f"u{i}@x.org" for i in range(12)], 2: [f"card{i}" for i in range(14)], 3: [f"+{i}" for i in range(9)]}
    unknown = [f"AB-{1000 + i}" for i in range(25)] + [f"u{i}(at)x.org" for i in range(10)]
    span = lambda kind, token, word: (kind, 0, 1, token, f"see {word} ")
    rows = []
    for _ in range(160):
        kind = rng.choice(list(known))
        base = [span(kind, rng.choice(known[kind]), rng.choice(words[:2 + kind]))]
        others = [span(None, rng.choice(unknown), rng.choice(words)) for _ in range(rng.randint(0, 1))]
        rows.append((base, others))
    entity = "array<struct<kind:int,begin:int,end:int,token:string,left:string>>"
    got = {(r.pattern, r.kind): r.confidence for r in pii.pattern_confidences(spark.createDataFrame(rows, f"base {entity}, others {entity}")).collect()}
    edges = {(" ".join(reversed(left.split())), token, kind, kind is None and "(at)" in token) for row in rows for spans in row for kind, _, _, token, left in spans}
    want = brute_confidences(edges)
    assert got.keys() == want.keys() and len(got) > 5
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_found_identifiers_teach_further_patterns(spark):
    """Accounts found behind a card's words stand behind other words too, where no card ever stands."""
    rows = [(i, t) for i, t in planted() if i < 20]
    rows += [(100 + i, f"lo charged to card AB{i}9-1234-XY ta") for i in range(2)]
    seeds = [f"KD-{7000 + i}-55" for i in range(12)]
    stems = [str(453957870000000 + 13 * i) for i in range(60)]
    rows += [(500 + i, f"lo charged to card {next(x + str(d) for d in range(10) if luhn(x + str(d)))} ta") for i, x in enumerate(stems)]
    rows += [(200 + i, f"lo charged to card {s} ta") for i, s in enumerate(seeds)]
    rows += [(300 + i, f"ru belongs to konto {s} vo") for i, s in enumerate(seeds)]
    rows += [(400, "ru belongs to konto ZZ-8811-77 vo"), (401, "ru order of vase ZZ-8811-78 vo")]
    found = {r.doc_id: [(pii.KINDS[s.kind], s.begin, s.end) for s in r.found] for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = dict(rows)[400].index("ZZ")
    assert found[400] == [("card", at, at + len("ZZ-8811-77"))] and not found[401]


def test_runs_of_any_length_and_columns_of_any_name(spark):
    long = " ".join(["4444"] * 3_000 + ["5"])
    rows = [(i, t, 1, "o") for i, t in planted() if i < 20] + [(90, f"lo charged to card {long} ta", 2, "p"), (91, "a." * 30_000 + " at " + "a-at-" * 30_000, 3, "q"), (92, "A" * 200_000 + "-1 " + "1a " * 60_000, 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int, others string")
    got = {r.doc_id: r for r in pii.extract(docs).collect()}
    assert [(s.begin, s.end) for s in got[90].found] == [(len("lo charged to card "), len("lo charged to card ") + len(long))]
    assert got[90].others == "p" and got[90]["_row"] == 2 and got[92].others is None


def test_context_reaches_behind_the_match_before(spark):
    docs = spark.createDataFrame([(1, "call 10.0.0.0 10.0.0.1 now")], "doc_id long, text string")
    lefts = [b.left for b in pii.find_entities(docs).first().base]
    assert lefts == ["call ", "call 10.0.0.0 "]
