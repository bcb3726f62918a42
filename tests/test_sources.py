"""Readers, stores and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import index, lsi, tfidf
from textloom.sources import readers, stores
from textloom.streaming.ingest import append_new, event_counts, stream_documents

ROW = {"doc_id": "a", "text": "héllo", "url": "u", "metadata": {"title": "T"}}


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_jsonl_keeps_good_rows(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text(json.dumps(ROW) + "\n\n{broken\n" + json.dumps({"doc_id": 2, "text": "t"}) + "\n", encoding="utf-8")
    got = {r["doc_id"]: r for r in readers.read_jsonl(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["2", "a"] and got["2"]["url"] == "" and got["2"]["metadata"] == {} and got["a"]["text"] == "héllo"


def test_json_object_array_and_errors(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(ROW))
    (tmp_path / "two.json").write_text(json.dumps([ROW, {**ROW, "doc_id": "b"}]))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "nourl.json").write_text(json.dumps({"doc_id": "c", "text": "t"}))
    assert ids(readers.load_file(spark, str(tmp_path / "two.json"))) == ["a", "b"]
    for bad in ("bad.json", "nourl.json"):
        with pytest.raises(Exception, match="not a document"):
            readers.load_file(spark, str(tmp_path / bad)).collect()
    assert ids(readers.read_json(spark, str(tmp_path), strict=False, glob="*.json")) == ["a", "a", "b", "c"]


def test_directory_by_suffix(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("plain\ntext")
    (tmp_path / "sub/b.md").write_text("# md")
    (tmp_path / "c.csv").write_text('x,y\n1,"two, three"\n')
    (tmp_path / "d.tsv").write_text("x\ty\n1\t2\n")
    (tmp_path / "e.html").write_text("<html><title>E</title><script>no</script><p>yes</p></html>")
    (tmp_path / "f.exe").write_text("?")
    got = {r["doc_id"].split("_r")[0]: r["text"] for r in readers.load_directory(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b", "c", "d", "e"} and got["a"] == "plain\ntext" and got["c"] == "x: 1\ny: two, three" and got["d"] == "x: 1\ny: 2" and got["e"] == "E\nyes"
    assert set(r["doc_id"] for r in readers.load_directory(spark, str(tmp_path), recursive=False).collect()) & {"b"} == set()
    assert ids(readers.load_directory(spark, str(tmp_path), "*.txt", "text")) == ["a"]
    for call in (lambda: readers.load_directory(spark, str(tmp_path / "none")), lambda: readers.load_directory(spark, str(tmp_path), format="x"), lambda: readers.load_file(spark, str(tmp_path / "f.exe"))):
        with pytest.raises(readers.LoaderError):
            call()


def test_rows_and_external(spark):
    assert ids(readers.from_rows(spark, [ROW])) == ["a"]
    with pytest.raises(readers.LoaderError, match="row 1"):
        readers.from_rows(spark, [ROW, {"doc_id": "x", "text": "t"}])
    x = spark.createDataFrame([("t", {"source": "/p/file.pdf", "page": "3"}), ("t", {"url": "U", "k": "v"})], "text string, metadata map<string,string>")
    a, b = readers.from_external(x).collect()
    assert (a["doc_id"], a["url"], a["metadata"]) == ("file_p3", "/p/file.pdf", {"page": "3"}) and b["url"] == "U" and b["metadata"] == {"k": "v"} and len(b["doc_id"]) == 16


def docs(spark, *pairs):
    return spark.createDataFrame([(i, t, "", {}) for i, t in pairs], "doc_id string, text string, url string, metadata map<string,string>")


def test_raw_store(spark, tmp_path):
    s = stores.RawStore(spark, str(tmp_path / "raw"))
    assert s.save(docs(spark, ("a", "t"), ("b", None)).withColumn("source", F.lit(" My Site"))) == 1
    assert s.exists("my site") and ids(s.load("My Site ")) == ["a"]
    s.save(docs(spark, ("c", "ñ")).withColumn("source", F.lit("my_site")))
    assert ids(s.load()) == ["a", "c"]
    s.clear("my site")
    assert not s.exists("my site")


def test_document_store(spark, tmp_path):
    s = stores.DocumentStore(spark, str(tmp_path / "docs"))
    assert not s.has("a") and s.get("a").count() == 0
    s.add(docs(spark, ("a", "old"), ("b", "t"), ("../x", "odd")))
    s.add(docs(spark, ("a", "new"), ("c", "t")))
    assert s.get("a").first()["text"] == "new" and s.get("../x").first()["text"] == "odd"
    want = spark.createDataFrame([(0, "c"), (1, "missing"), (2, "a")], "pos int, doc_id string")
    assert [r["doc_id"] for r in s.get_many(want).collect()] == ["c", "a"]
    assert s.delete("a") and not s.delete("a") and not s.has("a")


def test_index_store(spark, tmp_path):
    s = stores.IndexStore(spark, str(tmp_path / "index"))
    assert s.manifest() == {} and not s.exists()
    with pytest.raises(stores.StoreError):
        s.load()
    i = index.build(docs(spark, ("a", "xx yy"), ("b", "yy zz")))
    s.save(i)
    first = s.manifest()
    s.save(s.load())
    assert (first["n_documents"], first["n_terms"]) == (2, 3) and s.manifest()["created_at"] == first["created_at"]
    assert ids(s.doc_ids()) == ["a", "b"] and s.load_words().count() == 0
    s.save_words(spark.createDataFrame([("bb",), ("aa",), ("aa",)], "word string"))
    assert [r["word"] for r in s.load_words().orderBy("pos").collect()] == ["aa", "bb"]
    s.clear()
    assert not s.exists()


def test_model_store(spark, tmp_path):
    s = stores.ModelStore(spark, str(tmp_path / "model"))
    with pytest.raises(stores.StoreError):
        s.load()
    i = index.build(docs(spark, ("a", "xx yy"), ("b", "yy zz"), ("c", "zz ww")))
    m = tfidf.fit(i)
    w = tfidf.weights(i.postings, m)
    p = lsi.fit(w, 3, 4, 2)
    s.save(m, p)
    m2, p2 = s.load()
    assert m2.n_docs == 3 and (abs(p.components - p2.components) < 1e-12).all() and m2.vocabulary.count() == 4


def test_vector_store_replaces(spark, tmp_path):
    s = stores.VectorStore(spark, str(tmp_path / "vec"))
    v = lambda x: spark.createDataFrame([("a", "u", [x])], "doc_id string, url string, vec array<double>")
    s.add(v(1.0))
    s.add(v(2.0))
    assert [r["vec"] for r in s.load().collect()] == [[2.0]]


def test_stream_takes_each_id_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda n, *rows: (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
    put(1, ROW, {**ROW, "doc_id": "b"})
    run = lambda: append_new(stream_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    put(2, {**ROW, "text": "changed"}, {**ROW, "doc_id": "c"})
    run()
    got = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": "héllo", "b": "héllo", "c": "héllo"}


def test_event_counts(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0), ("2024-01-01 01:00:00", "x", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["n"], r["value"]) for r in event_counts(e).collect()) == [(1, 4.0), (2, 3.0)]


def test_skipped_pdf_files_are_counted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "_has_pdf", lambda: False)
    for n in ("a.txt", "b.pdf", "c.pdf"):
        (tmp_path / n).write_text("x")
    with pytest.warns(UserWarning, match=r"^2 \.pdf files"):
        assert readers.load_directory(spark, str(tmp_path)).count() == 1


def test_csv_files_of_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n7,8\n9\n\n10,11,12\n")
    (tmp_path / "b.csv").write_text('p,q,r\n1,"two\nlines, and more",3\n,,\n')
    (tmp_path / "c.csv").write_text("only\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.tsv").write_text("u\tv\n1,5\t2\n")
    got = {r["doc_id"]: r["text"] for r in readers.read_csv(spark, str(tmp_path), glob="*.csv").collect()}
    assert got == {"a_r0": "x: 7\ny: 8", "a_r1": "x: 9\ny: ", "a_r2": "x: 10\ny: 11\n3: 12", "b_r0": "p: 1\nq: two\nlines, and more\nr: 3", "b_r1": "p: \nq: \nr: "}
    assert [(r["doc_id"], r["text"]) for r in readers.load_file(spark, str(tmp_path / "e.tsv")).collect()] == [("e_r0", "u: 1,5\nv: 2")]


def test_directory_patterns_and_order(spark, tmp_path):
    for n in ("z.txt", "sub/b.txt", "sub/a.txt", "sub/deep/c.txt", "other/sub/d.txt", "m 1+2.txt"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    (tmp_path / "sub/rows.jsonl").write_text("\n".join(json.dumps({**ROW, "doc_id": f"j{i}", "url": f"u{9 - i}"}) for i in range(5)))
    load = lambda *a, **k: [r["doc_id"] for r in readers.load_directory(spark, str(tmp_path), *a, **k).collect()]
    assert load(ordered=True) == ["m 1+2", "d", "a", "b", "c", *(f"j{i}" for i in range(5)), "z"]
    assert sorted(load("sub/*.txt")) == ["a", "b", "d"] and load("sub/*.txt", recursive=False, ordered=True) == ["a", "b"]
    assert sorted(load("**/*.txt")) == ["a", "b", "c", "d", "m 1+2", "z"] and load("[a-z].txt", "text", recursive=False) == ["z"]
    assert sorted(load("*.txt", recursive=False)) == ["m 1+2", "z"] and load("sub/?.txt", recursive=False, ordered=True) == ["a", "b"] and load("no/*.txt") == []
    assert load("sub/*.jsonl", recursive=False, ordered=True) == [f"j{i}" for i in range(5)]


def test_last_write_wins(spark, tmp_path):
    s = stores.DocumentStore(spark, str(tmp_path / "docs"))
    s.add(docs(spark, ("a", "zzz old"), ("b", "t"), ("a", "aaa new"), (None, "x")))
    assert s.get("a").first()["text"] == "aaa new" and s._all().count() == 2
    s.add(docs(spark, ("a", "first"), ("a", "second")).withColumn("n", F.when(F.col("text") == "first", 9).otherwise(1)), order="n")
    assert s.get("a").first()["text"] == "first" and s.get("b").first()["text"] == "t"
    v = stores.VectorStore(spark, str(tmp_path / "vec"))
    v.add(spark.createDataFrame([("a", "u", [9.0]), ("a", "u", [1.0])], "doc_id string, url string, vec array<double>"))
    assert [r["vec"] for r in v.load().collect()] == [[1.0]]


def test_raw_store_names(spark, tmp_path):
    s = stores.RawStore(spark, str(tmp_path / "raw"))
    assert s.load().count() == 0 and not s.exists("x")
    for i, name in enumerate(["x:y", "A  b/c=d", "ñ%20"]):
        s.append({"doc_id": i, "text": f"t{i}", "metadata": {"k": 1}}, name)
        assert s.exists(name) and ids(s.load(name.upper() + " ")) == [str(i)]
    s.clear("X:Y")
    assert not s.exists("x:y") and ids(s.load()) == ["1", "2"]
    for bad in ({"doc_id": 1}, {"doc_id": 1, "text": "t", "metadata": {"k": object()}}):
        with pytest.raises(stores.StoreError):
            s.append(bad, "x")
    s.append({"doc_id": 7, "text": "t"}, "12")
    assert ids(s.load("12")) == ["7"]
