"""Canonical statements, look-alikes, encodings, personal data."""

import random

import pytest

from sqlloom.llm import lookalike, mojibake, personal, repeats
from sqlloom.llm.canonical import canonical

SAME = [
    ("SELECT a, b FROM t WHERE x = 1 AND y = 'Q q'", "select B,A\nfrom T where (Y='Q q') and x=1 ;\n/"),
    ("UPDATE t SET a = 1, b = 2 WHERE c BETWEEN 1 AND 2 AND d = 3", "update \"T\" set b=2,a=1 where d=3 and c between 1 and 2;;"),
    ("INSERT INTO h (a, b) SELECT x, y FROM t", "insert into h (b, a) select y, x from t;"),
    ("INSERT INTO h (a, b) VALUES (1, 2)", "INSERT INTO h (b,a) VALUES (2,1)"),
    ("SELECT a FROM t WHERE x IN (SELECT i FROM u WHERE p = 1 AND q = 2)", "SELECT a FROM t WHERE (x IN (SELECT i FROM u WHERE q = 2 AND p = 1))"),
    ("SELECT a FROM t WHERE (x = 1 OR y = 2) AND z = 3", "SELECT a FROM t WHERE z = 3 AND (x = 1 OR y = 2)"),
    ("SELECT a FROM t JOIN u ON t.i = u.i AND t.j = 2", "SELECT a FROM t JOIN u ON t.j=2 AND t.i=u.i"),
    ("-- Note\nSELECT a FROM t", "--   note\nselect a from t"),
]
OTHER = [
    ("SELECT a FROM t WHERE x = 'Q q'", "SELECT a FROM t WHERE x = 'q q'"),
    ("SELECT a FROM t WHERE x = 'Q q'", "SELECT a FROM t WHERE x = 'Qq'"),
    ("SELECT a FROM t ORDER BY a, b", "SELECT a FROM t ORDER BY b, a"),
    ("SELECT a FROM t WHERE x = 1.0", "SELECT a FROM t WHERE x = 1"),
    ("SELECT a FROM t WHERE x = -1", "SELECT a FROM t WHERE x = 1"),
    ("SELECT DISTINCT a FROM t", "SELECT a FROM t"),
    ("SELECT a FROM t WHERE x = 1 OR y = 2 AND z = 3", "SELECT a FROM t WHERE (x = 1 OR y = 2) AND z = 3"),
    ("SELECT a FROM t WHERE x BETWEEN 1 AND 2", "SELECT a FROM t WHERE x BETWEEN 2 AND 1"),
    ("INSERT INTO h (a, b) SELECT x, y FROM t", "INSERT INTO h (b, a) SELECT x, y FROM t"),
    ("SELECT a FROM t WHERE x IN (1, 2)", "SELECT a FROM t WHERE x IN (2, 1)"),
    ("SELECT a FROM t", "SELECT a FROM u"),
    ("-- one\nSELECT a FROM t", "SELECT a FROM t"),
    ("SELECT a FROM t WHERE x <> 1", "SELECT a FROM t WHERE x != 1"),
]


@pytest.mark.parametrize("a, b", SAME)
def test_same_statement(a, b):
    assert canonical(a) == canonical(b) is not None


@pytest.mark.parametrize("a, b", OTHER)
def test_other_statement(a, b):
    assert canonical(a) != canonical(b)


@pytest.mark.parametrize("sql", [None, "", " \n\t", ";", "/", ";;\n/"])
def test_no_statement(sql):
    assert canonical(sql) is None


@pytest.mark.parametrize("sql", ["SELECT (((", "))) a", "SELECT 'open", "/* open", "CASE WHEN a AND b THEN", "INSERT INTO t (", "(" * 400, "AND AND OR ,,", "中文 說明"])
def test_odd_texts_have_a_stable_form(sql):
    assert canonical(sql) == canonical(sql + "\n")


def test_bag_is_the_same_for_all_writings():
    import pyarrow as pa

    for a, b in SAME:
        h = repeats.bag_hashes(pa.array([a, b]))
        assert h[0] == h[1]
    assert list(repeats.bag_hashes(pa.array(["a", None, ""]).slice(0))) == list(repeats.bag_hashes(pa.array(["x", "a", None, ""]).slice(1)))


@pytest.mark.parametrize("bits", [1 << 16, repeats.MAX_FILTER_BITS])
def test_members_against_brute_force(spark, bits):
    rng = random.Random(5)
    base = [f"SELECT a, b FROM t{i % 90} WHERE x = {i % 40} AND y = 'V{i % 3}'" for i in range(400)]
    rows = []
    for k in range(1500):
        s = rng.choice(base) if k % 3 else base[0]  # a third of all rows is one statement
        rows.append((k, rng.choice([s, s.lower().replace("'v", "'V"), s.replace(", ", " ,\n"), s + ";"])))
    rows += [(5000, None), (5001, ""), (5002, "  "), *rows[:20]]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, s, "z", 1) for k, s in rows], "submission_id long, sql string, key string, hash int").repartition(5)
    sets = {}
    for k, s in dict(rows).items():
        if (c := canonical(s)) is not None:
            sets.setdefault(c, set()).add(k)
    want = {(min(m), k) for m in sets.values() for k in m if k != min(m)}
    assert {tuple(r) for r in repeats.members(df, "submission_id", "sql", bits).collect()} == want
    got = {r.keep_id: r.copies for r in repeats.collapsed(df, "submission_id", "sql", bits).collect()}
    assert got == {min(m): len(m) for m in sets.values()}
    assert repeats.members(df.limit(0), "submission_id", "sql").count() == 0


def disguise(rng, text):
    twins = {b: a for a, b in lookalike._LATIN.items()}
    out = []
    for c in text:
        r = rng.random()
        if c == " " and r < 0.3:
            c = rng.choice("  　")
        elif r < 0.06 and c in twins:
            c = twins[c]
        elif r < 0.12 and "!" <= c <= "~":
            c = chr(ord(c) + 0xFEE0)
        elif r < 0.2:
            c += rng.choice("​­⁠️")
        out.append(c)
    return "".join(out)


def test_look_alike_pairs(spark):
    rng = random.Random(3)
    base = [f"SELECT a.ref_no, b.name FROM permit_hdr a WHERE a.place = '{p}' AND a.n = {i} AND a.office = 'Old Quay'" for i, p in enumerate(["Северная гавань", "Златобор", "Καρανή", "Düne", "臨時", "Upper Weir"] * 30)]
    left = spark.createDataFrame([(i, s) for i, s in enumerate(base)] + [(900, None), (901, " "), (902, "x"), (0, base[0])], "k long, t string")
    right = spark.createDataFrame([(i, disguise(rng, s)) for i, s in enumerate(base)] + [(900, None), (901, ""), (903, base[3].replace("Düne", "Dune")), (904, base[3].replace("ü", "ü")), (905, base[0] + " "), (906, base[1])], "k long, t string")
    counts = lookalike.trigram_counts(left.select("t").union(right.select("t")))
    pairs = {tuple(r) for r in lookalike.same_looking(lookalike.one_form(left, "k", "t", counts), lookalike.one_form(right, "k", "t", counts)).collect()}
    changed = {r.k for r in right.collect() if r.k < len(base) and r.t != base[r.k]}
    found = {a for a, b in pairs if a == b}
    assert len(found & changed) >= 0.98 * len(changed)
    assert (3, 904) in pairs and not {b for _, b in pairs} & {900, 901, 903, 905, 906} and all(a == b or b == 904 for a, b in pairs)


def test_compatible_form():
    assert lookalike.compatible("ＡＢ　c​­d") == "AB cd" and lookalike.compatible("½ ² x̂") == "½ ² x̂" and lookalike.compatible("ü") == "ü"


CLEAN = ["Düne Süd", "São Bréza", "Северная гавань", "臨時許可", "查詢退件重送案件之明細資料", "Λιμένιον", "§ 12 Abs.", "½ lot", "Ñandoral", "修正：原條件漏列港務費", "逾期未繳", "青嵐分處", "12 °C", "Łubrowa"]


def test_encodings_held_out():
    found = {f"{p}{s}": 20 for p in CLEAN for s in ("", " x", " 0")}
    j = mojibake.Judge(mojibake.train(found))
    assert all(j.text(f"SELECT a FROM t WHERE p = '{c}' AND q = 1") is None for c in CLEAN)
    right = total = 0
    for c in CLEAN[:6]:
        for wrong in ("latin-1", "cp1252", "cp1251", "cp437", "cp850"):
            if (g := mojibake.garble(c, (("utf-8", wrong),))) is None:
                continue
            total += 1
            r = j.text(f"-- {g}\nSELECT 1 FROM t")
            assert r is not None, (c, wrong)
            right += r[1] == f"-- {c}\nSELECT 1 FROM t"
    assert right >= 0.9 * total
    assert j.text("x = 'D�ne'")[0][0].endswith("?") and j.text("plain") is None and j.text("") is None
    assert j.text("ï»¿SELECT 1")[1] == "﻿SELECT 1"


@pytest.mark.parametrize("chain", mojibake.CHAINS, ids=mojibake.name)
def test_chains_invert(chain):
    for c in CLEAN:
        g = mojibake.garble(c, chain)
        back = None if g is None or "�" in g else mojibake.invert(g, chain)
        assert back is None or back == c


def test_garbled_rows(spark):
    df = spark.createDataFrame([(1, "Düne Süd"), (1, "Düne Süd"), (2, "DÃ¼ne SÃ¼d"), (3, None), (4, ""), (5, "ascii")] + [(10 + i, c) for i, c in enumerate(CLEAN * 5)], "id long, t string")
    m = mojibake.train(mojibake.sample_pieces(df.select("t")))
    got = mojibake.garbled_rows(df, "id", "t", m).collect()
    assert [(r.key, r.recovered, r.restored) for r in got] == [(2, True, "Düne Süd")]


PEOPLE = [("Ada", "given"), ("Brun", "given"), ("Cleo", "given"), ("Kestrane", "family"), ("Moorland", "family"), ("Veldt", "family"), ("沈", "family")]


def personal_frame(spark):
    rng = random.Random(1)
    rows, want = [], {}
    given, family = ["Ada", "Brun", "Cleo", "Dagny", "Esko"], ["Kestrane", "Moorland", "Veldt", "Pellan"]
    for i in range(300):
        who = f"{rng.choice(given)} {rng.choice(family)}"
        kind, note = rng.choice([("person", f"owner: {who}"), ("person", f"asked by {who}"), ("phone", f"tel {rng.randint(200, 999)}-555-{rng.randint(1000, 9999)}"), ("id_number", f"ID A{rng.randint(100000000, 299999999)}"), ("email", f"mail {who.replace(' ', '.').lower()}@site.example"), ("email", "write to x.y [at] site dot example"), ("address", f"lives at {rng.randint(2, 90)} {rng.choice(['Mill', 'Tar'])} Lane, Flat 3"), ("person", "owner: 沈若晴"), (None, "Kestrane Bridge survey, sheet 12"), (None, "rows 2025-03-71 to 2025-04-17, ref 4471-458-18"), (None, "host 10.2.3.4, loaded through T@archlink")])
        rows.append((i, f"-- {note}\nSELECT a FROM t WHERE st = 'East Mole' AND n = {10**7 + i}", None))
        want[i] = kind
    rows += [(900, None, None), (901, "", ""), (902, "SELECT a FROM t WHERE tel_no = '415-555-0199'", 'Id,Operation\n0,X\n\nNote\n-----\n   - mail q@site.example'), (0, rows[0][1], None)]
    return spark.createDataFrame(rows, "submission_id long, sql string, plan_text string"), want


def test_personal_data(spark):
    df, want = personal_frame(spark)
    names = spark.createDataFrame(PEOPLE, "part_text string, part_kind string")
    fields = (("sql", False), ("plan_text", True))
    found = personal.judged(personal.collect(df, "submission_id", fields).cache(), names).dropDuplicates()
    got = {}
    for r in found.collect():
        got.setdefault((r.key, r.field), set()).add(r.kind)
    assert got.pop((902, "sql")) == {"phone"} and got.pop((902, "plan_text")) == {"email"}
    assert {k: v for (k, _), v in got.items()} == {k: {v} for k, v in want.items() if v}
    red = {r.submission_id: r for r in personal.redacted(df, "submission_id", fields, found).collect()}
    assert red[902].plan_text.endswith("mail <EMAIL>") and red[900].sql is None and red[901].sql == ""
    i = next(k for k, v in want.items() if v == "phone")
    assert red[i].sql.startswith("-- tel <PHONE>\nSELECT a FROM t")
    assert personal.judged(personal.collect(df.limit(0), "submission_id", fields), names).count() == 0


def test_disclosure_rejects_what_lists_suggest(spark):
    """A listed cue, street type or name part that the corpus mostly uses otherwise discloses nothing."""
    rows = [f"-- call {1000000 + i}.{i % 7}\nSELECT 1 FROM t" for i in range(3)]  # shapes that stand elsewhere as well
    rows += [f"-- batch {2000000 + i}.{i % 7}\nSELECT 1 FROM t" for i in range(200)]
    rows += [f"-- call +44 20 7946 {1000 + i}\nSELECT 1 FROM t" for i in range(2)]
    rows += [f"-- see Mark {w}\nSELECT 1 FROM t" for w in ("Sheet", "Column", "Table", "Row") for _ in range(60)]
    rows += ["-- Mark Lane wrote it\nSELECT 1 FROM t", "-- by Ada Kestrane\nSELECT 1 FROM t"] + [f"-- {i} Lane closures, Lane {i}\nSELECT 1" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "submission_id long, sql string")
    names = spark.createDataFrame([("Mark", "given", "latin"), ("Lane", "family", "latin"), ("Ada", "given", "latin"), ("Kestrane", "family", "latin")], "part_text string, part_kind string, script string")
    got = {(r.key, r.kind) for r in personal.judged(personal.collect(df, "submission_id", (("sql", False),)), names).collect()}
    assert {k for k, kind in got if kind == "phone"} == {203, 204}
    assert {rows[k] for k, kind in got if kind == "person"} == {"-- by Ada Kestrane\nSELECT 1 FROM t"}


def test_cues_far_back_count(spark):
    wide, many = " " * 500, ", ".join(["'x'"] * 2000)
    assert personal.cue_before(f"owner:{wide}Ada", 506) == "owner"
    c = personal.Collector()
    assert c.text(f"SELECT 1 FROM t WHERE tel_no {wide} = '415-555-0199'", False)[0][3] == "tel_no"
    assert c.text(f"SELECT 1 FROM t WHERE tel_no IN ({many}, '415-555-0199')", False)[0][3] == "tel_no"


def test_repeats_in_ranges_of_hashes(spark):
    """A filter too small for the rows is cut into ranges; sets stay the same and few singletons pass."""
    df = spark.range(60_000).selectExpr("id", "concat('SELECT a, b FROM t', md5(string(IF(id % 20 = 0, id % 500, id))), ' WHERE x = ', id % 20) AS sql")
    want = sorted(repeats.members(df, "id", "sql").collect())
    got = sorted(repeats.members(df, "id", "sql", 1 << 16).collect())
    assert got == want and len(want) == 3000 - 25
    assert len(repeats.filters(df.select("sql"), 1 << 18)) == 1 and len(repeats.filters(df.select("sql"), 1 << 16)) >= 1
    passed = repeats.sieve(df, "id", "sql", 1 << 16).where("hash IS NOT NULL").count()
    assert 3000 <= passed < 3000 + 0.02 * 60_000


def test_sound_pieces_are_known_beyond_the_sample(spark):
    usual = ["Düne Süd", "Северная гавань", "臨時許可", "修正：原條件漏列港務費", "Λιμένιον"]
    rare = ["à x", "ñ y", "ø z", "ß w"]  # too few letters for the scores
    garbled = [mojibake.garble(p, (("utf-8", "latin-1"),)) for p in rare]
    texts = [*usual * 20, *rare * 3, *garbled]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    counts = mojibake.piece_counts(df.select("t"))
    model = mojibake.train(mojibake.most_frequent(counts, len(usual)))
    assert not model.sound & set(rare)
    sound = {bytes(r.h) for r in mojibake.sound_pieces(counts, model).collect()}
    assert {p for p in [*usual, *rare, *garbled] if mojibake.hashed(mojibake.normal(p)) in sound} == {*usual, *rare}
    got = {r.key: r.restored for r in mojibake.garbled_rows(df, "id", "t", model, mojibake.sound_pieces(counts, model)).collect()}
    assert got == {len(texts) - len(rare) + i: p for i, p in enumerate(rare)}
    few = mojibake.SAMPLE_PIECES
    try:  # with nearly all pieces joined, none held in memory
        mojibake.SAMPLE_PIECES = 1
        assert {r.key: r.restored for r in mojibake.garbled_rows(df, "id", "t", model, mojibake.sound_pieces(counts, model)).collect()} == got
    finally:
        mojibake.SAMPLE_PIECES = few


def test_literals_of_every_shape_are_collected():
    def found(t):
        return [(t[m[0] : m[1]], m[2], m[3]) for m in personal.Collector().text(t, False)]

    assert found("SELECT a FROM t WHERE tel_no = '0912345678'") == [("0912345678", "number", "tel_no")]
    assert found("SELECT a FROM t WHERE nm LIKE '%Jane Roe%'") == [("Jane Roe", "name", "nm")]
    assert found("SELECT a FROM t WHERE m = 'jane[at]example[dot]org'") == [("jane[at]example[dot]org", "mail", "m")]
    many = ", ".join(f"'X-{i:05d}'" for i in range(200))
    assert found(f"SELECT a FROM t WHERE tel_no IN ({many}, '415-555-0199') AND f(b, '415-555-0188') = 1") == [("415-555-0199", "number", "tel_no"), ("415-555-0188", "number", "literal")]
    assert found("SELECT a FROM t WHERE d = '2024-01-31' AND k = 'A-12345678' AND s = '%open%'") == []


def test_long_tokens_are_read_whole(spark):
    """A look-alike in a token of thousands of letters is read with the script of its neighbours, before and behind."""
    words = spark.createDataFrame([("passenger manifest of the harbour " * 50,)], "t string")
    read = lookalike.Reader(*lookalike.trigram_counts(words))
    long = "passengermanifest" * 200
    assert len(long) > 3000 and read(long.replace("a", "а")) == long and read(long[:255] + "е" + long[256:]) == long[:255] + ("e" if long[255] != "e" else "e") + long[256:]
    assert read("x_1_" * 900 + "а") == read("x_1_" * 900 + "a")


@pytest.mark.parametrize("depth", [200, 400, 4000])
def test_brackets_of_any_depth_are_canonical(depth):
    a, b = ("SELECT a FROM t WHERE " + "(" * depth + c + ")" * depth for c in ("p = 1 AND q = 2", "q = 2 AND p = 1"))
    assert canonical(a) == canonical(b) != canonical(b.replace("q = 2", "q = 3"))
    x, y = ("SELECT a FROM t WHERE " + "(x = 1 OR " * depth + c + ")" * depth for c in ("p = 1 AND q = 2", "q = 2 AND p = 1"))
    assert canonical(x) == canonical(y) != canonical(y.replace("q = 2", "q = 3"))


def test_look_alike_classes_are_linear(spark):
    """Many copies of one writing on both sides give no pairs; classes hold each row once."""
    left = spark.createDataFrame([(i, "SELECT 1", "SELECT 1") for i in range(300)] + [(900, "ＳＥＬＥＣＴ 1", "SELECT 1")], "key long, text string, form string")
    right = spark.createDataFrame([(i, "SELECT 1", "SELECT 1") for i in range(300)] + [(5, "SELECT 2", "SELECT 2")], "key long, text string, form string")
    assert {(r.left_key, r.right_key) for r in lookalike.same_looking(left, right).collect()} == {(900, i) for i in range(300)}
    assert lookalike.same_looking_classes(left, right).count() == 601
