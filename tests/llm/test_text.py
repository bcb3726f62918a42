"""Text operators on small hand-made tables, with every kind of missing value."""

import pickle
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from textloom.functions.flat import flatten
from textloom.llm import bpe, language, packing, quality, repeated, styletree
from textloom.llm.lines import cut_lines, normal_keys

DOCS = "doc_id long, text string, source string, doc string"


def docs(spark, rows):
    """With a column whose name clashes with none of the operators' own."""
    return spark.createDataFrame([(i, t, s, "extra") for i, (t, s) in enumerate(rows)], DOCS)


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_runs_and_hashes_against_regex():
    texts = ["Ab, c2!\n x²—ñ", None, "", "  ", "éa" * 50, "ΑΣ İz", "\U0001f600 ok"]
    got = []
    for lo, to, f in flatten(pa.array(texts), nfc=True, lower=True):
        a, b = f.runs((f.cls == 1) | (f.cls == 2))
        got += [(int(r) + lo, f.text(x, y), int(h)) for r, x, y, h in zip(f.rows_of(a), a, b, f.hashes(a, b))]
    want = [(i, w) for i, t in enumerate(texts) if t for w in regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFC", t).lower())]
    assert [x[:2] for x in got] == want
    by = {}
    for _, w, h in got:
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_normal_lines_have_equal_keys_only_if_equal():
    lines = ["© 2024 Foo. All", "foo  2 ALL", "a1b22", "a0b7", "a b", "ab", "", "--", "x 1 2", "x 12", "é", "é"]
    norm = lambda l: regex.sub(r"[^\p{L}\p{N}]+", " ", regex.sub("[0-9]+", "0", unicodedata.normalize("NFC", l).lower())).strip()
    (_, _, f), = flatten(pa.array(["\n".join(lines)]), nfc=True, lower=True)
    _, _, start, end = cut_lines(f)
    a, b, has = normal_keys(f, start, end)
    for i, x in enumerate(lines):
        assert has[i] == (norm(x) != "")
        for j, y in enumerate(lines):
            assert ((a[i], b[i]) == (a[j], b[j])) == (norm(x) == norm(y))


def brute_repeated(rows, least):
    norm = lambda l: regex.sub(r"[^\p{L}\p{N}]+", " ", regex.sub("[0-9]+", "0", unicodedata.normalize("NFC", l).lower())).strip()
    seen = {}
    for i, (t, s) in enumerate(rows):
        if t is None or s is None:
            continue
        key = "_".join(s.split()).lower()
        for n, l in enumerate(t.split("\n")):
            if norm(l):
                seen.setdefault((key, norm(l)), []).append((i, n))
    return sorted(x for v in seen.values() if len({i for i, _ in v}) >= least for x in v)


ROWS = [("Notice 1\nown a", "S"), ("notice 22!\nnotice 3", " s "), ("x\n\n--\nNOTICE 4\r", "s"), ("notice 1", None), (None, "s"), ("", "s"), (" \n", "s"), ("Notice 5", "other"), ("own b " * 5000, "s")]


@pytest.mark.parametrize("small", [True, False])
def test_repeated_lines(spark, monkeypatch, small):
    from textloom.plans import runtime

    if not small:  # the way beyond what may be broadcast
        monkeypatch.setattr(runtime, "SMALL_ROWS", 0)
        monkeypatch.setattr(runtime, "HOT_KEYS", 1)
    assert pairs(repeated.repeated_lines(docs(spark, ROWS), 3), "doc_id", "line_no") == brute_repeated(ROWS, 3)


def test_documents_without_repeated_lines(spark):
    out = {r["doc_id"]: r for r in repeated.without_repeated_lines(docs(spark, ROWS), 3).collect()}
    assert out[0]["text"] == "own a" and out[1]["text"] == "" and out[2]["text"] == "x\n\n--" and out[3]["text"] == "notice 1"
    assert out[4]["text"] is None and out[7]["text"] == "Notice 5" and out[8]["text"] == ROWS[8][0] and out[0]["doc"] == "extra" and len(out) == len(ROWS)
    assert repeated.repeated_lines(docs(spark, ROWS).limit(0), 3).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_rows_of_one_doc_id_are_one_document(spark, monkeypatch, few):
    if not few:  # the way beyond what is sent to the tasks
        monkeypatch.setattr(repeated, "MOST_KEYS", 0)
    rows = [(1, "Note 1\nown\r\nñ note 2", "s"), (1, "Note 1\nown\r\nñ note 2", "s"), (1, "note 1", "S "), (2, "note 9\n\U0001f600 é x\nnote 3", "s"), (None, "note 1\nz", "s"), (3, "note 1", None), (4, None, "s"), (5, "keep\nnote 7\nlast", "s"), (6, "other", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("meta", F.array(F.lit(1)))
    assert pairs(repeated.repeated_lines(d, 4), "doc_id") == [] and set(pairs(repeated.repeated_lines(d, 3), "doc_id", "line_no", "documents")) == {(1, 0, 3), (2, 0, 3), (2, 2, 3), (5, 1, 3)}
    assert pairs(repeated.repeated_lines(d, 2, 0.7), "doc_id", "line_no") == [(1, 0), (2, 0), (2, 2), (5, 1)] and repeated.repeated_lines(d, 2, 0.8).count() == 0
    got = sorted((r["doc_id"] or 0, r["text"]) for r in repeated.without_repeated_lines(d, 3).where("text is not null").collect())
    assert got == [(0, "note 1\nz"), (1, ""), (1, "own\r\nñ note 2"), (1, "own\r\nñ note 2"), (2, "\U0001f600 é x"), (3, "note 1"), (5, "keep\nlast"), (6, "other")]


@pytest.fixture(scope="module")
def encoding():
    import base64

    import tiktoken

    P = pytest.importorskip("public_tokenizers")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_public_tokenizer(spark, encoding):
    rng = random.Random(5)
    chars = "aeéñz  \n\t\r'sdmtl0129½²٣_.,!¿— 　​한字🙂<|endoftext|>"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [None, "", " ", "it's we'll ''s 's", "<|endoftext|>", "a" * 3000, "ab" * 400 + "\n" * 300, "x" * 255, "x" * 257]
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_texts(docs(spark, [(t, "s") for t in texts])).collect()}
    for i, t in enumerate(texts):
        assert got[i] == encoding.encode_ordinary(t or ""), repr(t)
    counts = {r["doc_id"]: r["tokens"] for r in bpe.count_tokens(docs(spark, [(t, "s") for t in texts])).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


def test_packing_is_whole_and_tight(spark):
    rng = np.random.default_rng(2)
    sizes = [0, None, 5000, 2048, 2049, 1] + np.clip(rng.lognormal(5.5, 1, 3000), 1, 2048).astype(int).tolist()
    items = spark.createDataFrame([(i if i % 3 else 7, s) for i, s in enumerate(sizes)], "doc_id long, tokens long")  # a third share an id
    out = packing.pack_items(items, group=1000).toPandas()
    assert out.tokens.sum() == sum(s or 0 for s in sizes)
    use = out.groupby("bin_id").agg(n=("tokens", "sum"), c=("capacity", "first"))
    assert (use.n <= use.c).all() and use.c.max() == 2048 and use.n.sum() / use.c.sum() > 0.99
    big = out[out.doc_id.isin([2, 4])].groupby("doc_id").tokens.apply(lambda x: sorted(x, reverse=True)).to_dict()
    assert big[2] == [2048, 2048, 904] and big[4] == [2048, 1]
    assert packing.pack_items(items.limit(0)).count() == 0


def test_one_long_item_is_dealt_to_groups(spark):
    out = packing.pack_items(spark.createDataFrame([(1, 2048 * 500 + 3), (2, 5)], "doc_id long, tokens long"), group=100).toPandas()
    assert out.tokens.sum() == 2048 * 500 + 8 and (out.bin_id // 2**32).value_counts().max() < 200
    assert sorted(out[out.doc_id == 1].start) == [2048 * i for i in range(501)]


def plain_best_fit(sizes, top=2048):
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits)[1]] -= s
        else:
            room.append(top - s)
    return [top - r for r in room]


def test_lengths_are_weighed_jointly():
    rng = np.random.default_rng(0)
    for lo, hi in ((600, 720), (1000, 1300), (700, 1000), (1, 2048), (20, 400)):
        sizes = rng.integers(lo, hi, 600)
        _, size = packing.pack(sizes)
        used = plain_best_fit(sizes)
        shrunk = np.array(packing.LENGTHS)[np.searchsorted(packing.LENGTHS, used)]
        cost, plain = size.sum() + packing.OVERHEAD * len(size), shrunk.sum() + packing.OVERHEAD * len(shrunk)
        print(lo, hi, len(size), cost, len(used), plain, 2080 * len(used))
        assert cost <= plain * 1.001
    _, size = packing.pack(np.full(100, 1100))
    assert set(size) == {1280}
    _, size = packing.pack(np.full(100, 760))
    assert set(size) == {1536}  # one bin of two has the overhead once


def test_packing_opens_the_cheapest_bin():
    into, size = packing.pack(np.array([100, 150]))
    assert len(size) == 1 and size[0] == 256 and set(into) == {0}
    into, size = packing.pack(np.array([2048, 10]))
    assert sorted(size) == [256, 2048]


SAMPLES = [(lang, t) for lang, ts in {
    "en": ["The patient should drink water and rest at home.", "When the pain gets worse, talk to the doctor about it.", "Most people feel better after a few days of rest.", "This is what the nurse says about the fever at night.", "There are many ways to treat the cough of a child.", "Some of them would rather wait until the morning."],
    "es": ["El paciente debe beber agua y descansar en casa.", "Cuando el dolor empeora, hable con el médico sobre ello.", "La mayoría de las personas mejora tras unos días de reposo.", "Esto es lo que la enfermera dice sobre la fiebre nocturna.", "Hay muchas maneras de tratar la tos de un niño.", "Algunos de ellos prefieren esperar hasta la mañana."],
}.items() for t in ts]


def test_languages(spark):
    model = language.train(spark.createDataFrame([*SAMPLES, (None, "x"), ("en", None)], "lang string, text string"))
    en, es = "The nurse says that the people should rest when the pain gets worse.", "La enfermera dice que las personas deben descansar cuando el dolor empeora."
    d = docs(spark, [(f"{en}\n\n\n{es}\n{es}\n \n{en}", "s"), (es, "s"), (None, "s"), ("", "s"), ("\n \n", "s"), ("1234 5678", "s"), ("xkcdq zzrtv qqwpl " * 10, "s")])
    b = {(r["doc_id"], r["block_no"]): r["lang"] for r in language.block_languages(d, model).collect()}
    assert b == {(0, 0): "en", (0, 1): "es", (0, 2): "en", (1, 0): "es", (5, 0): None, (6, 0): None}
    got = {r["doc_id"]: (r["lang"], r["confidence"]) for r in language.document_languages(d, model).collect()}
    assert got[1][0] == "es" and got[1][1] > 0.9 and got[3] == (None, 0.0) and 2 not in got
    kinds = d.select("doc_id", F.lit("prose").alias("kind"))
    wrong = language.wrong_labels(d.withColumn("lang", F.lit("EN-gb")), model, kinds)
    assert pairs(wrong, "doc_id", "block_no", "lang") == [(0, 1, "es"), (1, 0, "es")]
    unknown = language.wrong_labels(d.withColumn("lang", F.lit("??")), model, kinds.withColumn("kind", F.when(F.col("doc_id") == 1, "junk").otherwise("prose")))
    assert pairs(unknown, "doc_id", "block_no") == [(0, 0), (0, 1), (0, 2)]


def test_segments_and_a_sixth_language(spark):
    more = [("it", t) for t in ("Il paziente deve bere acqua e riposare a casa.", "Quando il dolore peggiora, parli con il medico di questo.", "La maggior parte delle persone migliora dopo alcuni giorni di riposo.", "Questo è quello che dice l'infermiera della febbre di notte.", "Ci sono molti modi di curare la tosse di un bambino.", "Alcuni di loro preferiscono aspettare fino al mattino.")]
    model = language.train(spark.createDataFrame([*SAMPLES, *more], "lang string, text string"))
    en, es, it = "The nurse says that the people should rest when the pain gets worse.", "La enfermera dice que las personas deben descansar cuando el dolor empeora.", "L'infermiera dice che le persone devono riposare quando il dolore peggiora."
    d = docs(spark, [(f"{en} 12! {en}\n{es}\n\n{it}", "s"), ("1234", "s"), (None, "s"), ("", "s")])
    assert pairs(language.segment_languages(d, model), "doc_id", "block_no", "segment_no", "words", "lang") == [(0, 0, 0, 26, "en"), (0, 0, 1, 12, "es"), (0, 1, 0, 12, "it")]
    kinds = d.select("doc_id", F.lit("prose").alias("kind"))
    said = lambda x: pairs(language.wrong_labels(d.withColumn("lang", F.lit(x)), model, kinds), "block_no", "lang")
    assert said("en") == [(1, "it")] and said("IT-ch") == [(0, "en")] and said("xx") == [(0, "en"), (1, "it")]


def test_held_out_language_accuracy(spark):
    path = "/root/testdata/sf0.01/lang_samples.parquet"
    pytest.importorskip("pyarrow.parquet")
    import os

    if not os.path.exists(path):
        pytest.skip("no test tables")
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(path).orderBy("lang", "sample_no").collect()]
    model = language.Model([x for i, x in enumerate(rows) if i % 4])
    held = [x for i, x in enumerate(rows) if not i % 4]
    got = {r["doc_id"]: r["lang"] for r in language.document_languages(docs(spark, [(t, "s") for _, t in held]), model).collect()}
    assert sum(got[i] == lang for i, (lang, _) in enumerate(held)) / len(held) >= 0.98


def test_words_are_scored_once_and_alike(monkeypatch):
    model, scored = language.Model([x for x in SAMPLES]), []
    scores = model.word_scores
    model.word_scores = lambda f, start, end: scored.extend(f.text(a, b) for a, b in zip(start, end)) or scores(f, start, end)
    texts = ["The nurse says rest.\n\nLa tos, the cough", "the nurse: la tos?", "", "12"]
    label = lambda m: [language.label_flat(m, f) for t in texts for _, _, f in flatten(pa.array([t]), nfc=True, lower=True)]
    got = [label(model), label(model)]
    assert sorted(scored) == sorted({w for t in texts for w in regex.findall(r"\p{L}+", t.lower())})
    for places in (1, 2, language.MEMO):  # words that take each other's place
        monkeypatch.setattr(language, "MEMO", places)
        other = language.Model([x for x in SAMPLES])
        got += [label(other), label(pickle.loads(pickle.dumps(other)))]
    assert pickle.loads(pickle.dumps(other))._memo is None
    for x in got[1:]:
        for one, two in zip(got[0], x):
            assert all(np.array_equal(one[k], two[k]) for k in one if k != "segments")


def test_case_of_a_text_does_not_depend_on_the_next():
    (_, _, f), = flatten(pa.array(["ΑΣ", "Χ", "é", "ΑΣ\nΧ"]), nfc=True, lower=True)
    assert [f.text(a, b) for a, b in zip(f.off[:-1], f.off[1:])] == ["ας", "χ", "é", "ας\nχ"]


def test_stated_language(spark):
    given = ["es", "es-MX", "spa", "Spanish", "EN", "en_US", "deu", "Portuguese", "", "??", "und", None]
    d = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string")
    assert [r[0] for r in d.orderBy("i").select(language.stated_language(F.col("g"))).collect()] == ["es"] * 4 + ["en"] * 2 + ["de", "pt"] + [None] * 4


PROSE = "The nurse says that it is a good thing to rest. There are some people who would rather wait for a day or two."


def test_kinds(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(8))
    kinds = {
        "list": ["\n".join(f"- {word()} {word()}" for _ in range(9)), "\n".join(f"{i}. {word()}" for i in range(9)), "Here is the list of things for the day:\n" + "\n".join(f"{word()}, {word()}" for _ in range(9))],
        "table": ["\n".join(f"{word()};{i};n/a;{i * 3}%" for i in range(9)), "\n".join(f"{word()}\t{i}\t-" for i in range(9)), "\n".join(f"{word()}     {i} mg     -     3.1" for i in range(9))],
        "junk": ["#@{}^ ~|<>$ %&[] ¬¬ ^^~\n" * 3, "xkcd qwrt zzpl bcdf ghjk\n" * 3, "a1b2" * 30, "click offer click offer click offer click offer click offer click offer", "1 22 333 44 5 6 77 8 99"],
        "prose": [PROSE, "\n\n".join([PROSE] * 4) + "\n- one\n- two", "\n".join(["the rest of the day was good for the people who had to wait"] * 5), "", " \n", "ok"],
    }
    rows = [(t, None) for k in kinds for t in kinds[k]]
    rows.append((None, "s"))
    common = "the of and to in a is that it for was on are as with they be at this have from or had by some there who would".split()
    out = {r["doc_id"]: r for r in quality.text_kinds(docs(spark, rows * 3), common).collect()}
    want = [k for k in kinds for _ in kinds[k]]
    assert [out[i]["kind"] for i in range(len(want)) if want[i] != "prose" or rows[i][0] != "ok"] == [k for i, k in enumerate(want) if k != "prose" or rows[i][0] != "ok"]
    assert len(want) not in out and out[want.index("prose")]["words"] == len(PROSE.split())
    assert all(abs(sum(r[f"p_{k}"] for k in quality.KINDS) - 1) < 1e-9 for r in out.values())
    assert quality.text_kinds(docs(spark, rows).limit(0), common).count() == 0


def test_repeated_lines_do_not_count_for_the_kind(spark):
    foot = "\n".join(f"Foot note {x} of the house" for x in "abcdefgh")
    rows = [(f"{PROSE} {i}\n{foot}", "s") for i in range(7)] + [("\n".join(f"- it{'abcdefg'[i]}em{j}" for j in "uvwxy") + "\n" + foot, "s") for i in range(7)]
    out = {r["doc_id"]: r["kind"] for r in quality.text_kinds(docs(spark, rows), ["the", "of", "is", "a"]).collect()}
    assert [out[i] for i in range(14)] == ["prose"] * 7 + ["list"] * 7


def test_style_tree(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeio") for _ in range(4)) for _ in range(5000)]
    signs = ["Fever", "Cough", "Nausea", "Tired feet", "Itching"]
    rows, want = [], []
    for i in range(240):
        lines, drop = [], []

        def add(block, bad, lines=lines, drop=drop):
            if lines:
                lines.append("")
            for x in block:
                if bad:
                    drop.append(len(lines))
                lines.append(x)

        if i % 5:
            add(["Home", "Topics", "Search", f"Home > Topics > {names[i]}"], True)
        add([names[i].title()], False)
        for _ in range(3):
            p = " ".join(f"{rng.choice(['some', 'many', 'most'])} people with {rng.choice(names)} {rng.choice(['rest', 'walk', 'sleep', 'eat'])} {rng.choice(['at home', 'at night', 'all day'])} and {rng.choice(names)}." for _ in range(3))
            add(["Causes", p], False)
            add([f"- {x}" for x in rng.sample(signs, 3)], False)
            if rng.random() < 0.4:
                add(["Most read", f"Five tips for {rng.choice(names)}", f"Quiz: can you spot {rng.choice(names)}?"], True)
        if i % 4:
            add(["Legal notice", f"© {2000 + i % 25} House"], True)
        rows.append((f"p{i}", "\n".join(lines), f"https://www.x.example/en/{i}", "t"))
        want += [(f"p{i}", n) for n in drop]
    rows += [rows[3], ("null", None, None, "t"), ("blank", " \n ", "u", "t"), ("alone", "Nothing like this is said anywhere else on any of the pages.", None, "t")]
    d = spark.createDataFrame(rows, "doc_id string, text string, url string, style string")
    got = set(pairs(styletree.boilerplate_lines(d), "doc_id", "line_no"))
    both = len(got & set(want))
    assert both / len(got) > 0.98 and both / len(want) > 0.97
    assert not {i for i, _ in got} & {"null", "blank", "alone"}
    text = {r["doc_id"]: r["text"] for r in styletree.article_text(d).collect()}
    assert "Home" not in text["p3"].split("\n") and names[3].title() in text["p3"].split("\n") and text["alone"] == rows[-1][1]
    assert styletree.boilerplate_lines(d.limit(0)).count() == 0


def test_two_texts_of_one_doc_id(spark):
    rows = [("a", "one\ntwo\nthree\nfour", "https://x.org/1"), ("a", "five", "https://x.org/1"), ("a", "five", "https://www.y.org/1"), ("a", "one\ntwo\nthree\nfour", None), ("b", "five", None)]
    d = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id string, text string, url string, h int, host string")
    assert sorted((r["doc_id"], r["text"]) for r in styletree.article_text(d).collect()) == [("a", "five"), ("a", "one\ntwo\nthree\nfour"), ("b", "five")]
    assert styletree.article_text(d.limit(0)).count() == 0
