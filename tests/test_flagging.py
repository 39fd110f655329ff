import random
import re

import pytest

from plain import counting_matches, excerpt, redact, scan
from quern.functions import phrases as P
from quern.operators import flagging

PATTERNS = [r"licen[cs]e[ds]?", r'token = "[0-9a-f]+', r"all rights reserved", r"\bthe \w+ing\b"]
KEYWORDS = ["from", "est"]


def _flag(spark, texts, patterns, keywords, window=120):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq int, text string")
    rows = flagging.flag_phrases(df, patterns, keywords, window).orderBy("seq").collect()
    return [r.phrases for r in rows]


def test_documents_equal_plain_loop(spark, documents, document_rows):
    got = {r.doc_id: r for r in flagging.flag_phrases(documents, PATTERNS, KEYWORDS).collect()}
    for row in document_rows:
        assert got[row["doc_id"]].phrases == counting_matches(row["text"], PATTERNS, KEYWORDS)
        assert got[row["doc_id"]].excerpt == excerpt(row["text"])


def test_context_edges(spark):
    texts = [
        "bad",
        "law bad",
        "law" + "x" * 117 + "bad",
        "law" + "x" * 118 + "bad",
        "law" + "😀" * 117 + "bad",
        "law" + "😀" * 118 + "bad",
        "law bad" + "y" * 130 + "bad",
        "bad law",
        "LAW bad",
        "ends bad",
        "a\r\nlaw\n bad",
        "",
        None,
        "Keen bad",
        "ſaw bad",
    ]
    for keywords in (["law"], ["keen", "saw"], []):
        want = [counting_matches(t, [r"bad"], keywords) for t in texts]
        assert _flag(spark, texts, [r"bad"], keywords) == want


def test_keyword_inside_match_does_not_excuse(spark):
    assert _flag(spark, ["no law bad here"], [r"law bad"], ["law"]) == [["law bad"]]


def test_excused_match_is_consumed(spark):
    """A later overlapping start must not count once the excused match has taken its text."""
    texts = ["law" + "x" * 117 + "aaaa", "law" + "x" * 116 + "aaaaaa"]
    want = [counting_matches(t, [r"aaa"], ["law"]) for t in texts]
    assert _flag(spark, texts, [r"aaa"], ["law"]) == want


def test_random_texts(spark):
    rng = random.Random(11)
    pieces = ["bad", "BAD", "worse thing", "law", "Law", "É", "é", "😀", "\n", "\r", " ", ".", "\x1c", "x" * 40, "ſ", "K", "1"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 30))) for _ in range(400)]
    patterns = [r"\bbad\b", r"worse\s+thing", r"é+", r"b(a)d(?:.)", r"\d$"]
    for keywords, window in ((["law"], 120), (["law", "x"], 20), (["é"], 5)):
        want = [counting_matches(t, patterns, keywords, window) for t in texts]
        assert _flag(spark, texts, patterns, keywords, window) == want


def test_split_is_complete_and_disjoint(documents):
    annotated = flagging.flag_phrases(documents, PATTERNS, KEYWORDS)
    hit, clean = flagging.split_flagged(annotated)
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in (hit, clean)]
    assert not ids[0] & ids[1] and len(ids[0] | ids[1]) == documents.count()
    assert clean.columns == documents.columns
    counts = flagging.flag_counts(annotated).first()
    assert (counts.documents, counts.flagged, counts.retained) == (200, len(ids[0]), len(ids[1]))
    assert {r.doc_id for r in flagging.flagged(documents, PATTERNS, KEYWORDS).collect()} == ids[0]
    assert {r.doc_id for r in flagging.retained(documents, PATTERNS, KEYWORDS).collect()} == ids[1]


@pytest.mark.parametrize("pattern", ["a*", r"(a)\1", r"(?P<n>a)(?P=n)", ""])
def test_unusable_patterns(pattern):
    with pytest.raises(ValueError):
        P.to_java(pattern)


def test_shared_heads_match_what_the_patterns_do(spark):
    patterns = [
        r"\bbad(?:ly)?\b", r"\bband\s+aid", r"\bba+r", r"ba?d", r"bad|worse", r"[]|]x", r"[^]|]yz", r"a\|b", r"(a|b)c",
        r"\bBad thing", r"\.dot", r"\\back", r"c{2}d", r"\d\d", r"é+x", r"-dash", r"worse", r"a\ b", r"\bb\b",
    ]
    rng = random.Random(5)
    pieces = ["bad", "ly", "band", " ", "aid", "baar", "bd", "worse", "]", "|", "x", "yz", "a", "b", "c", "cc", "d", ".dot", "\\back", "12", "éé", "-dash", "thing", "\n", "😀"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq int, text string")
    for some in [patterns, *[rng.sample(patterns, 4) for _ in range(12)], *[[p] for p in patterns]]:
        got = {r.seq for r in df.filter(df.text.rlike(P.any_pattern(some))).collect()}
        assert got == {i for i, t in enumerate(texts) if any(re.search(p, t, re.IGNORECASE) for p in some)}
    literals = ["bad", "ba", "b|a", "a b", "[]", ".dot", "\\back", "\n", "-d"]
    got = {r.seq for r in df.filter(df.text.rlike(P.any_literal(literals))).collect()}
    assert got == {i for i, t in enumerate(texts) if any(x in t.lower() for x in literals)}


def test_empty_policy(spark):
    assert _flag(spark, ["a"], [], ["x"]) == [[]]
    assert _flag(spark, ["bad"], ["bad"], [""]) == [[]]


def test_scan_equals_plain_loop(spark, documents, document_rows):
    phrases = ["license", "THE", "information that is rather long", "on on", "é"]
    rows = flagging.scan_phrases(documents.select("doc_id", "text"), phrases).collect()
    got = sorted(tuple(r) for r in rows)
    want = sorted((d["doc_id"], *hit) for d in document_rows for hit in scan(d["text"], phrases))
    assert got == want and len(want) > 1000


def test_scan_of_odd_texts(spark):
    phrases = ["a.b", "\\E", "[x]", "😀b", "aa", "k"]
    texts = ["a.b A.B acb", "😀a.b\\E[X]", "x😀B😀b", "aaaaa", "K", "", None, "\\e\\E"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq int, text string")
    got = sorted(tuple(r) for r in flagging.scan_phrases(df, phrases).collect())
    assert got == sorted((i, *hit) for i, t in enumerate(texts) for hit in scan(t or "", phrases))
    blocked = {r.seq: r.blocked for r in flagging.has_phrase(df, phrases).collect()}
    assert blocked == {i: bool(scan(t or "", phrases)) for i, t in enumerate(texts)}
    assert flagging.scan_phrases(df, []).collect() == []
    assert not any(r.blocked for r in flagging.has_phrase(df, []).collect())


def test_redaction(spark):
    phrases = ["all rights", "rights reserved", "a.b", "\\E", "red", "$1"]
    texts = ["All rights reserved", "rights RESERVED all", "a.b acb \\E", "red", "pay $1 now", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.text for r in flagging.redact(df, phrases).collect()]
    assert got == [redact(t, phrases) for t in texts]
    once = [r.text for r in flagging.redact(df, phrases, mode="single_pass").collect()]
    assert once[3] == "[REDACTED]" and got[3] == "[REDACTED]"
    both = flagging.redact(spark.createDataFrame([("all rights",)], "text string"), ["all rights", "red"])
    assert both.first().text == redact("all rights", ["all rights", "red"]) == "[[REDACTED]ACTED]"
    rescanned = flagging.scan_phrases(flagging.redact(df, phrases[:4]), phrases[:4])
    assert rescanned.count() == 0
    dollars = flagging.redact(df, ["now"], token="$0\\")
    assert dollars.collect()[4].text == "pay $1 $0\\"


@pytest.mark.parametrize("limit", [0, 100])
def test_banned_words(spark, limit):
    words = ["bad", "é", "a.c"]
    texts = ["BAD", "embadded", "good", "É", "abc", "a.c", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq int, text string")
    kept = {r.seq for r in flagging.filter_banned(df, words, contains_limit=limit).collect()}
    assert kept == {i for i, t in enumerate(texts) if not any(w in (t or "").lower() for w in words)}
    assert flagging.filter_banned(df, []).count() == len(texts)


def test_long_word_list_equals_short(documents):
    words = ["password", "licen", "secret"] + [f"zq{i}zq" for i in range(300)]
    short = flagging.filter_banned(documents, words[:3])
    assert flagging.filter_banned(documents, words).count() == short.count() < documents.count()


def test_many_patterns_stay_one_scan(documents):
    """The plan filters by one alternation before any per-pattern work."""
    plan = flagging.flagged(documents, PATTERNS, KEYWORDS)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("regexp_extract_all", plan)) == 2 * len(PATTERNS)
    assert plan.count("Filter") == 1
