"""Tokenizer ids, mixtures, residue, and all queries of the subpackage."""

import base64
import os
import random

import pytest

from conftest import DATA
from sqlloom.llm import bpe, mixture, queries, residue

FILE = os.path.join(bpe.FOLDER, "byte_bpe_50k.tiktoken")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(FILE), reason="no tokenizer files here")


@needs_vocabulary
def test_ids_against_the_library(spark):
    import tiktoken

    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["", " ", "\n\n \t x", "Hello, world's end!", "人民請安靜" * 300, "a" * 5000, "é" * 700, "".join(rng.choice("ab \n中é1,") for _ in range(3000)), "<|endoftext|>", "\U0001f600 ok", "x" * 511, "ab" * 256, "\u0000​"]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x2FF), rng.randint(0x4E00, 0x9FFF)])) for _ in range(rng.randint(1, 80))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(9000, None, None)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in bpe.token_ids(df, "doc_id", "text", bpe.load()).collect()}
    assert got.pop(9000) == [] and got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(df, ["doc_id"], "text", bpe.load()).collect()}
    assert counts == {i: len(x) for i, x in got.items()} | {9000: 0}
    assert all(enc.decode(got[i]) == t for i, t in enumerate(texts))


def test_allocation():
    got = mixture.allocation({"a": 1000, "b": 10, "c": 500}, [("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.3, 3)], 1510)
    assert got["b"] == 20 and abs(sum(got.values()) - 1510) < 1e-6 and got["a"] <= 1000 and abs(got["a"] / got["c"] - 5 / 3) < 1e-6
    assert mixture.allocation({}, [("a", 1.0, 2)], 0) == {"a": 0.0}


def test_mixture(spark):
    rng = random.Random(4)
    docs = [(i, rng.choices(["a", "b", "c", None, "x"], [60, 20, 10, 2, 8])[0], rng.choice([0, 5, 40, 300])) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.35, 3), ("c", 0.25, 2), ("gone", 0.0, 5)], "source string, target_share double, max_repeats int")
    uses = mixture.mixed(df, targets)
    rows = {r.doc_id: r for r in uses.collect()}
    assert len(rows) == 6000 and all(rows[i].uses == 0 for i, s, _ in docs if s in (None, "x"))
    most = {"a": 1, "b": 3, "c": 2}
    assert all(rows[i].uses <= most[s] for i, s, _ in docs if s in most)
    total = sum(n for _, s, n in docs if s in most)
    assert abs(sum(r.uses * r.n_tokens for r in rows.values()) - total) <= 3 * 300
    sizes = {s: sum(n for _, t, n in docs if t == s) for s in most}
    want = mixture.allocation(sizes, [("a", 0.4, 1), ("b", 0.35, 3), ("c", 0.25, 2)], total)
    shares = {r.source: r for r in mixture.shares(uses, targets).collect()}
    assert all(abs(shares[s].used_tokens - want[s]) <= 300 for s in most) and shares["gone"].used_tokens == 0
    assert rows == {r.doc_id: r for r in mixture.mixed(df.repartition(7), targets).collect()}  # the same draw again
    assert mixture.mixed(df.limit(0), targets).count() == 0


def test_inclusion_is_uniform_within_a_source(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "'a' AS source", "10L AS n_tokens").unionByName(spark.range(20000, 40000).selectExpr("id AS doc_id", "'b' AS source", "10L AS n_tokens"))
    targets = spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 1)], "source string, target_share double, max_repeats int")
    n = {(r.source, r.half): r.n for r in mixture.mixed(df, targets).selectExpr("source", "doc_id % 2 AS half", "uses").groupBy("source", "half").agg({"uses": "sum"}).withColumnRenamed("sum(uses)", "n").collect()}
    assert n["a", 0] + n["a", 1] == 28000 and abs(n["a", 0] - n["a", 1]) < 400 and abs(n["b", 0] - n["b", 1]) < 400


RESIDUE = ["404 Not Found\nThe transcript you asked for is not on this server.", "Bitte aktivieren Sie JavaScript, um das Protokoll anzuzeigen.", "{{ speaker.name }}: I thank the House.", "The pump ${AREA_NAME} failed.", "[INSERT NAME OF MOVER]", "[à compléter : résultat du vote]", "<speech text to be supplied>", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Sample text. Please delete before publication.", "找不到網頁（錯誤 404）。", "Mr Speaker, I was\n\nError 503: Service temporarily unavailable.", "%%PARTY%%", "This application does not\nwork without scripting."]
SPEECH = ["The portal says JavaScript is required, and half of the county uses old library computers.", "Section 404 of the Act was not found wanting by the Minister.", "The service was temporarily unavailable for 19 days in\nthe border parishes, and nobody apologised.", "Printers call it lorem ipsum; the Minister calls it a strategy.", "[Laughter] [Interruption.] (Applause) （掌聲）", "[Name withheld at the Member's request] wrote to me.", 'The draft still read "insert figure here" when we saw it.', 'An error page is not a policy, and "try again later" is not an answer.', "20 % of the budget and 30% of the rest", "部會網站整整9天都顯示找不到網頁，這樣對嗎？", "", None, "  \n"]


def test_residue(spark):
    filler = [f"The House heard speech number {i} on the ferry subsidy and the water tariff; nobody in the county was asked. Please sign the record." for i in range(300)]
    texts = RESIDUE + SPEECH + filler
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kinds string")
    m = residue.Matcher(residue.frequencies(df, "text"))
    got = {r.doc_id for r in residue.residue(df, "doc_id", "text", m).collect()}
    assert got == set(range(len(RESIDUE))), [texts[i] for i in got ^ set(range(len(RESIDUE)))]
    assert residue.residue(df.limit(0), "doc_id", "text", residue.Matcher()).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@needs_vocabulary
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    want = {"p2_found": ["submission_id", "extract_id"], "p3_found": ["keep_id", "submission_id"], "p4_found": ["table_name", "row_id"], "p5_found": ["submission_id", "field_name", "kind"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns == want.get(name, df.columns)
    assert df.count() == df.dropDuplicates().count()


def test_inclusion_grows_with_size_and_refined_bins_agree(spark, monkeypatch):
    df = spark.range(30000).selectExpr("id AS doc_id", "'a' AS source", "IF(id % 2 = 0, 10L, 160L) AS n_tokens").unionByName(spark.range(30000, 30010).selectExpr("id AS doc_id", "'b' AS source", "4000000L AS n_tokens"))
    targets = spark.createDataFrame([("a", 0.02, 2), ("b", 0.98, 1)], "source string, target_share double, max_repeats int")
    got = mixture.mixed(df, targets)
    n = {r.n_tokens: r.n for r in got.where("source = 'a'").groupBy("n_tokens").agg({"uses": "sum"}).withColumnRenamed("sum(uses)", "n").collect()}
    assert 3.6 < n[160] / n[10] < 4.4  # the square root of 16
    whole = sorted(got.collect())
    monkeypatch.setattr(mixture, "BINS", 8)
    monkeypatch.setattr(mixture, "EDGE", 5)
    assert sorted(mixture.mixed(df, targets).collect()) == whole
    twice = {r.doc_id: r.uses for r in mixture.mixed(df.unionByName(df.where("doc_id < 9")), targets).collect()}
    assert len(twice) == 30010


#: Everyday notices and slots that were written after the exemplars and are in none of them.
HELD_OUT = ["We could not find the page you were looking for (404).", "Whoops! An unexpected error has occurred, please go back to the home page.", "You need to enable scripts in your browser in order to use this application.", "Your login session has expired, please log in again.", "Gateway timeout (504)", "The site is undergoing scheduled maintenance. Check back soon.", "Erreur 500 : erreur interne du serveur", "Bitte aktivieren Sie JavaScript in Ihrem Browser!", "La página que busca ya no existe.", "Il servizio non è al momento disponibile: errore interno del server.", "系統維護中，請稍後再試", "页面不存在", "このページを表示するには JavaScript を有効にしてください", "Dear [First Name],", "Yours, {{sender_signature_line}}", "Meeting on [DATE TO BE CONFIRMED]", "[hier Text einfügen]", "Sample text only, delete before publishing.", "Sed ut perspiciatis unde omnis iste natus error sit voluptatem.", "Texte provisoire, à compléter", "%%RECIPIENT_CITY%%", "Contact: <phone number>"]


def test_residue_of_wording_in_no_exemplar(spark):
    speech = [f"The House heard speech number {i} on the ferry subsidy and the water tariff; the page and the site of the ministry were not mentioned in it." for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(speech + HELD_OUT)], "doc_id long, text string")
    got = {r.doc_id for r in residue.residue(df, "doc_id", "text", residue.Matcher(residue.frequencies(df, "text"))).collect()}
    assert not any(i < 300 for i in got) and len(got) >= 0.9 * len(HELD_OUT), [HELD_OUT[i] for i in range(len(HELD_OUT)) if i + 300 not in got]


def test_no_lengths_or_numbers_are_capped(spark):
    names = [f"field of kind {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} and more words than forty characters hold" for i in range(2500)]
    texts = [f"Speech {{{{{n}}}}} of the Member." for n in names] + [f"Speech [{n}] of the Member." for n in names]
    texts += ["Speech {{" + "x" * 5000 + "}} here.", "Speech [insert " + "word " * 1 + "y" * 3000 + "] here.", "Speech [Laughter] here.", "Speech here."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(spark.range(10_000, 70_000).selectExpr("id AS doc_id", "concat('Speech ', id, ' of the Member.') AS text"))
    got = {r.doc_id for r in residue.residue(df, "doc_id", "text", residue.Matcher(residue.frequencies(df, "text"))).collect()}
    assert set(range(len(texts))) - got == {len(texts) - 2, len(texts) - 1}


def test_long_passages_are_windowed():
    speech = "the minister spoke about ferries and harbours and nobody in the county was asked about them " * 40
    m = residue.Matcher(residue.Frequencies(10, {}, frozenset(residue.words(speech))))
    assert m.document(speech)[0] == set()
    assert m.document(speech + "the requested url was not found on this server " + speech)[0] == {"server"}
    assert m.document(speech + "\nvelum lorem contas sit dolumque tares ipsum merga quam nolis " * 30 + speech)[0] == {"filler"}


@pytest.mark.parametrize("text", ["", "Plain words, WORDS", "404 x xx xxxx 12 中文字abc漢 _a_b 5x", "Ünïcode naïve １２３ 503"])
def test_distinct_words_are_the_words(text):
    assert residue.distinct_words(text) == set(residue.words(text))
