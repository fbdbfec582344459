"""Hand-made cases of the core operators."""

import json
import zipfile

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import balance as B
from corpusloom.operators import dedup as D
from corpusloom.operators import extract as E
from corpusloom.sources import files, html
from corpusloom.streaming import streams


def test_keep_policies_and_hot_copies(spark):
    rows = [(i, "same text") for i in range(1000)] + [(2000, "other"), (2001, None), (2002, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in D.keep(df, "doc_id", "text").where("kept").collect()}
    assert kept == {0, 2000, 2001, 2002}
    again = df.join(D.keep(df, "doc_id", "text").where("kept").select("doc_id"), "doc_id")
    assert D.keep(again, "doc_id", "text").where("not kept").count() == 0  # idempotent


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert D.keep(df, "doc_id", "text").count() == 0
    assert D.annotate(df, "doc_id", "text").count() == 0
    m = B.metrics(df, F.col("lang")).collect()[0]
    assert m["classes"] == 0 and m["entropy"] is None


def test_metric_bounds(spark):
    df = spark.createDataFrame([("a",)] * 7 + [("b",)] * 2 + [("c",)], "lang string")
    m = B.metrics(df, F.col("lang")).collect()[0]
    assert 0 <= m["gini"] < 1 and 0 < m["entropy"] <= 1.585 and m["dominance"] == 3.5 and m["max_ratio"] == 7
    one = B.metrics(spark.createDataFrame([("a",)], "lang string"), F.col("lang")).collect()[0]
    assert one["dominance"] == float("inf") and one["balance_ratio"] == 1.0


def test_format_and_html(spark):
    df = spark.createDataFrame([(0, "<title>x</title><main>a&amp;b<p>c</p></main>")], "n long, h string")
    r = df.select(X.format_size(F.lit(1536)).alias("s"), html.title(F.col("h")).alias("t"), html.text(F.col("h")).alias("x")).collect()[0]
    assert (r["s"], r["t"], r["x"]) == ("1.50 KB", "x", "a&b\nc")


def test_symbol_positions_agree_with_counts(spark):
    df = spark.createDataFrame([(1, "BTC/USD fell 5.5 percent to $3,000 (BTC)"), (2, None), (3, "")], "doc_id long, text string")
    p = E.symbol_positions(df, "doc_id", "text").groupBy("doc_id", "type", "symbol").agg(F.count("*").alias("n"))
    c = E.symbols(df, "doc_id", "text")
    assert sorted(map(tuple, p.collect())) == sorted(map(tuple, c.select(*p.columns).collect()))


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    (tmp_path / "in" / "b.py").write_text('import os\ndef f():\n    """Doc."""\n    return 1\n')
    with zipfile.ZipFile(tmp_path / "e.epub", "w") as z:
        z.writestr("c1.xhtml", "<p>Chapter</p>")
    assert files.epub_text("", (tmp_path / "e.epub").read_bytes()) == "Chapter"
    f = files.scan(spark, str(tmp_path / "in"))
    assert {r["text"] for r in files.texts(f).collect()} >= {"hello"}
    out = {r["path"][-4:]: r["text"] for r in files.extract_with(f, files.python_text).collect()}
    assert out["b.py"].startswith("import os") and "Doc." in out["b.py"]
    df = spark.createDataFrame([(1, "d", "ok"), (2, None, "low_quality")], "doc_id long, domain string, quality_flag string")
    files.write_routed(df, str(tmp_path / "routed"))
    assert spark.read.parquet(str(tmp_path / "routed")).where("quality_bucket = 'low_quality'").count() == 1
    m = files.export(df, str(tmp_path / "export"), "v1")
    assert m["domains"] == {"d": 1, "unknown": 1}
    assert json.loads(spark.read.text(str(tmp_path / "export_manifest")).collect()[0][0]) == m


def test_stream_equals_batch(spark, tmp_path):
    like = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    like.write.parquet(str(tmp_path / "ev"))
    s = streams.daily_counts(streams.events(spark, str(tmp_path / "ev"), like), "event_type")
    q = s.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    batch = like.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(str, spark.table("daily").collect())) == sorted(map(str, batch.collect()))


def test_stream_seen_keys_and_rules(spark, tmp_path):
    like = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    like.union(like).coalesce(1).write.parquet(str(tmp_path / "twice"))
    s = streams.unseen(streams.events(spark, str(tmp_path / "twice"), like), "event_id")
    q = s.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == like.count()
    got = []
    r = streams.auto_balance(streams.events(spark, str(tmp_path / "twice"), like), "event_type", lambda df, k: got.extend(df.collect()))
    q = r.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.awaitTermination(120)
    assert all(x["severity"] in ("critical", "warning", "info") for x in got)


def test_repository_works_without_the_subpackage():
    import __spark_entry__ as entry

    core = {k for k in entry.queries() if not (k[0] == "p" and k[1].isdigit())}
    assert "corpus_overview" in core and core == set(__import__("corpusloom.plans.catalog", fromlist=["x"]).QUERIES)


def test_history_has_every_class(spark):
    from corpusloom.plans import catalog

    dated = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("collected_at is not null")
    for name in ("history_languages", "history_domains"):
        h = catalog.QUERIES[name](spark, "/root/testdata/sf0.01")
        assert h.agg(F.sum("n")).first()[0] == dated.count()
    assert {r["class"] for r in catalog.QUERIES["history_languages"](spark, "/root/testdata/sf0.01").collect()} >= {"es", "pt", "ru", "zh", "unknown"}


def test_operators_of_literals_cover_the_tables(spark):
    from corpusloom.plans import catalog

    d = "/root/testdata/sf0.01"
    n, q = {t: spark.read.parquet(f"{d}/{t}.parquet").count() for t in ("documents", "activity_log")}, catalog.QUERIES
    assert q["markdown_strip_documents"](spark, d).count() == n["documents"]
    assert q["log_parse_activity"](spark, d).count() == n["activity_log"]
    assert q["formula_complexity_documents"](spark, d).count() == q["formulas"](spark, d).count()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    want = {(r["i"], r["j"]) for r in q["dedup_near_exact"](spark, d).collect()}
    got = {(r["i"], r["j"]): r["value"] for r in q["char_similarity_documents"](spark, d).collect()}
    assert got.keys() == want and want
    for (i, j), v in got.items():
        a, b = text[i], text[j]
        assert abs(v - sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b))) < 1e-4
    jac = {(r["i"], r["j"]): r["value"] for r in q["jaccard_pairs_documents"](spark, d).collect()}
    assert jac.keys() == want and all(0.5 < v <= 1 for v in jac.values())


def broadcasts(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "BroadcastExchange" in x]


def test_prefixes_and_texts_of_pairs_are_not_broadcast(spark, tmp_path):
    from corpusloom.operators import near

    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(f"v{k}" for k in range(40)), None, " "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path := str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(path)
    cut = near.keyed(df, "text").select("key", near.spaced("text").alias("text"))
    rows = near.checkpoint(near.prefixes(cut, near.sketch(cut, 18, near.WORDS), 18, near.WORDS, near.THRESHOLD).withColumn("u", F.monotonically_increasing_id()))
    cand = near.candidates(rows, near.THRESHOLD)
    assert cand.count() == 1 and not broadcasts(cand)
    pairs = near.linked_texts(df, "doc_id", "text")
    assert [tuple(r) for r in pairs.collect()] == [(0, 1, texts[0], texts[1])] and not broadcasts(pairs)


def test_classes_of_copies_are_not_broadcast(spark, tmp_path):
    from corpusloom.operators import near

    spark.createDataFrame([(k, f"t{k // 2}") for k in range(1, 9)], "doc_id long, text string").coalesce(1).write.parquet(path := str(tmp_path / "documents.parquet"))
    got = near.classes(spark.read.parquet(path), "doc_id", "text")
    assert {r["id"]: r["rep"] for r in got.collect()} == {k: max(1, k // 2 * 2) for k in range(1, 9)} and not broadcasts(got)


def test_size_estimates_do_not_grow_with_the_rounds_of_components(spark, monkeypatch):
    import random

    from corpusloom.operators import near

    order = random.Random(1).sample(range(40), 40)
    p = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "u long, v long")
    sizes = []
    keep = near.checkpoint
    monkeypatch.setattr(near, "checkpoint", lambda df: sizes.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) or keep(df))
    label = near.components(p.union(p.select("v", "u")))
    assert label.count() == 40 and not label.where("l <> 0").count()
    assert len(sizes) > 4 and max(sizes) < 2**260


def test_links_are_counted_without_components(spark, tmp_path, monkeypatch):
    from corpusloom.operators import near
    from corpusloom.plans import catalog

    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(words), " ".join(f"v{k}" for k in range(40)), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.delattr(near, "components")
    got = {r["doc_id"]: r["links"] for r in catalog.QUERIES["dedup_near"](spark, str(tmp_path)).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0}


def test_formula_stats_count_formulas_with_braces(spark, tmp_path):
    from corpusloom.plans import catalog

    rows = [(1, r"Let \begin{equation} x = y \end{equation} hold."), (2, r"So $x^{a^{b^{c}}}$ grows."), (3, "We set y = a + b here.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["type"], r["bucket"]): r["n"] for r in catalog.QUERIES["formula_stats"](spark, str(tmp_path)).collect()}
    # formulas count without their delimiters: x = y has one operator, three levels of braces make 0.6
    assert got["equation_env", "simple"] == 1 and got["inline_latex", "medium"] == 1


def test_translation_rules_fire_one_by_one(spark):
    from corpusloom.operators import translation as MT

    filler = " ".join(f"The word{k} of group{k} was in place{k}." for k in range(40))
    texts = {
        "disclaimer": "This was translated by a machine. " + filler, "phrase": "Same here. Same here. Same here. " + filler, "gram": "one two three x one two three y one two three z one two three w " + filler,
        "code": "x = 1\n" + filler + " one two three one two three one two three one two three", "listed": "\n".join(["- one two three"] * 9), "short": "Hello there.", "none": None, "empty": "",
    }
    rows = [(k, t, "x") for k, t in texts.items()] + [("excluded", texts["gram"], "API")]
    got = {r["id"]: r for r in MT.detect(spark.createDataFrame(rows, "id string, text string, domain string"), "id", "text", F.col("domain")).collect()}
    assert got["gram"]["flag"] and got["gram"]["severity"] == "critical" and got["gram"]["confidence"] == 0.9
    assert got["disclaimer"]["score"] >= 50 and got["disclaimer"]["flag"] and got["phrase"]["score"] >= 30
    for k in ("code", "excluded", "short", "none", "empty"):
        assert not got[k]["flag"] and got[k]["severity"] == "ok" and got[k]["confidence"] == 0.0, k
    m = MT.measure("He is going. They had worked hard and it worked.")
    assert m[9] == 2 / 3 and MT.measure(texts["listed"])[5] and not MT.measure("a\n- b")[5]


def test_classify_takes_whole_words(spark):
    config = spark.createDataFrame([("finance", ["risk margin"]), ("other", ["cap-weighted"]), ("none", [])], "domain string, search_terms array<string>")
    rows = [(1, "the asterisk and the brisk marginalia", None), (2, "a risk, a Margin; risk", "Risk"), (3, "cap-weighted cap weighted", None), (4, None, None)]
    got = {r["id"]: (r["domain"], r["score"]) for r in E.classify(spark.createDataFrame(rows, "id long, t string, title string"), config, "id", "t", "title").collect()}
    assert got[1] == ("unknown", 0.0) and got[4] == ("unknown", 0.0) and got[2][0] == "finance"
    assert got[2][1] == round(0.7 + 0.3 * 6 / (8 / 20), 6) and got[3] == ("other", round(0.7 + 0.3 / (3 / 20), 6))


def test_chunks_end_behind_sentences():
    text = "One. Two is here. " * 30
    parts = X.chunk_limits(text, 100, 10)
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(b - a <= 100 for a, b in parts)
    assert all(text[:b].endswith(". ") for _, b in parts) and all(y[0] == x[1] - 10 for x, y in zip(parts, parts[1:]))
    assert X.chunk_limits("x" * 250, 100, 10) == [(0, 100), (90, 190), (180, 250)]


def test_dirty_files(spark, tmp_path):
    d = tmp_path / "dirty"
    (d / "sub").mkdir(parents=True)
    (d / "bad.txt").write_bytes(b"caf\xe9 \xff ok")
    (d / "t.csv").write_text('name,n\n"a, b",1\n,2\nshort\n')
    (d / "u.tsv").write_text("x\ty\n1\t2\n")
    (d / "j.json").write_text('{"title": "T", "n": [1, {"k": "deep"}], "none": null}')
    (d / "broken.json").write_text('{"title": ')
    (d / "m.md").write_text("---\ntitle: Head\ntags: a, b\n---\n# One\ntext")
    (d / ".hidden.txt").write_text("no")
    with zipfile.ZipFile(d / "e.epub", "w") as z:
        z.writestr("content.opf", "<package xmlns:dc='x'><metadata><dc:title>Book &amp; Co</dc:title><dc:creator>A</dc:creator></metadata></package>")
        z.writestr("c1.xhtml", "<p>Chapter</p>")
    f = files.scan(spark, str(d))
    plain = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.texts(f).collect()}
    assert plain["bad.txt"] == "caf\ufffd \ufffd ok" and ".hidden.txt" not in plain
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.extract(f).collect()}
    assert rows["t.csv"]["text"] == "name: a, b; n: 1\nn: 2\nname: short" and rows["u.tsv"]["text"] == "x: 1; y: 2"
    assert rows["j.json"]["text"] == "title: T\nn.0: 1\nn.1.k: deep" and rows["broken.json"]["text"] == '{"title": '
    assert rows["m.md"]["text"] == "# One\ntext" and rows["m.md"]["metadata"] == {"title": "Head", "tags": "a, b"}
    assert rows["e.epub"]["text"] == "Chapter" and rows["e.epub"]["metadata"] == {"title": "Book & Co", "creator": "A"}


def test_feed_with_a_namespace(spark):
    feed = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title><entry><id>1</id><title>A &amp; B</title><published>2024-01-02T00:00:00Z</published><summary> s </summary><author><name>X</name></author><author><name>Y</name></author></entry><entry><id>2</id><title>C</title></entry></feed>'
    df = spark.createDataFrame([(1, feed), (2, "<entry><id>9</id><title>Z</title></entry>"), (3, "broken <"), (4, None)], "k long, x string")
    got = {(r["k"], r["p"]["id"]): r["p"] for r in df.select("k", F.explode(html.papers(F.col("x"))).alias("p")).collect()}
    assert set(got) == {(1, "1"), (1, "2"), (2, "9")}
    assert got[1, "1"]["title"] == "A & B" and got[1, "1"]["authors"] == ["X", "Y"] and got[1, "1"]["summary"] == "s" and got[1, "2"]["authors"] == []


def test_malformed_html(spark):
    bad = "<html><head><title>T &mdash; x</title><meta name='author' content=\"A B\"></head><body><nav>no</nav><p>One<p>Two &eacute;<table><tr><td>a<td>b<tr><td><table><tr><td>in</table><td>c</table><a href='/rel'>r</a> <a HREF='http://x.y/z'>Z</a><script>if (a < b) {}</script>"
    r = spark.createDataFrame([(1, bad), (2, None), (3, "")], "k long, h string").select("k", html.page("h", F.lit("http://s.t/d/")).alias("p")).collect()
    p = {x["k"]: x["p"] for x in r}
    assert p[1]["title"] == "T \u2014 x" and p[1]["meta"] == {"author": "A B"} and p[1]["text"].split("\n")[:2] == ["One", "Two \u00e9"] and "no" not in p[1]["text"].split()
    assert ["a", "b"] in p[1]["tables"][0] and p[1]["tables"][1] == [["in"]]
    assert [tuple(x) for x in p[1]["links"]] == [("http://s.t/rel", "r"), ("http://x.y/z", "Z")]
    assert p[2]["text"] is None and p[3]["text"] == ""


def test_exports_and_safe_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "b", "y")], "doc_id long, domain string, text string")
    m = files.export(df, str(tmp_path / "out"), "1.0")
    assert m["domains"] == {"a": 1, "b": 2} and files.export(df, str(tmp_path / "dry"), "1.0", dry_run=True) == m and not (tmp_path / "dry").exists()
    assert files.free_name(str(tmp_path), "out") == str(tmp_path / "out_1") and files.free_name(str(tmp_path), "new") == str(tmp_path / "new")
    z = files.zip_export(str(tmp_path / "out"), str(tmp_path / "out.zip"), m)
    with zipfile.ZipFile(z) as f:
        assert "manifest.json" in f.namelist() and json.loads(f.read("manifest.json")) == m and len(f.namelist()) > 2
    plan = files.move_plan(spark.createDataFrame([("/c/a.txt", "x"), ("/d/a.txt", "x"), ("/d/b.txt", None)], "path string, domain string"), "/t").collect()
    assert sorted(r["target"] for r in plan) == ["/t/unknown/b.txt", "/t/x/a.txt", "/t/x/a_1.txt"]


def test_groups_are_numbered_over_ranges(spark):
    df = spark.range(0, 5000, 3).withColumn("x", F.col("id") * 2).repartition(7)
    got = D.numbered(df, "id").select("id", "no").orderBy("id").collect()
    assert [r["no"] for r in got] == list(range(1, len(got) + 1))
    assert D.numbered(df.where("false"), "id").count() == 0
    plan = D.annotate(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")], "doc_id long, text string"), "doc_id", "text").collect()
    assert {(r["doc_id"], r["group_id"]) for r in plan} == {(1, "dg-001"), (2, "dg-001"), (3, "dg-002"), (4, "dg-002")}


def test_config_checks_and_sync(spark):
    make = lambda rows: spark.createDataFrame(rows, "key string, weight double")
    a, b = make([("x", 0.5), ("x", 0.5), ("y", 0.3), ("z", None)]), make([("y", 0.4), ("w", 0.6)])
    got = {(r["check"], r["key"]) for r in B.config_check(a, b).collect()}
    assert got == {("missing", "x"), ("missing", "z"), ("extra", "w"), ("mismatch", "y"), ("duplicate", "x"), ("sum", "a")}
    safe = {r["key"]: r["weight"] for r in B.config_sync(make([("y", 0.3)]), b).collect()}
    assert safe == {"y": 0.3, "w": 0.6} and {r["key"]: r["weight"] for r in B.config_sync(make([("y", 0.3)]), b, force=True).collect()} == {"y": 0.4, "w": 0.6}
    assert B.config_check(make([]), make([])).count() == 2  # sums of nothing


def test_quality_rules_and_report(spark):
    rows = [("a", "low_quality", "pdf")] * 60 + [("b", "ok", "pdf")] * 10 + [(None, "ok", "txt")]
    df = spark.createDataFrame(rows, "domain string, flag string, kind string")
    plan = spark.createDataFrame([("c", 0, 10)], "domain string, current long, target long")
    got = {(r["severity"], r["action"], r["subject"]) for r in B.quality_rules(df, F.col("domain"), F.col("flag"), F.col("kind"), plan).collect()}
    assert got == {("high", "collect", "c"), ("medium", "downsample", "a"), ("critical", "review_quality", "low_quality"), ("medium", "diversify_types", "pdf")}
    page = B.report_markdown(df, F.col("domain"), "Corpus")
    assert page.startswith("# Corpus") and "| a | 60 | 84.5 % |" in page and "low_entropy" in page


def test_log_lines(spark):
    from corpusloom.operators import activity as A

    lines = ["[2024-01-02 03:04:05] INFO collector - started | 3 files", "2024-01-02 03:04:05,123 - app.core - ERROR - Failed hard", "2024-01-03 03:04:05,123 - app.core - ERROR - failed again", "free text"]
    p = A.parse_lines(spark.createDataFrame([(x,) for x in lines], "line string"), "line")
    assert A.filter_lines(p, level="error", component="app.core", text="FAILED", day=F.to_date(F.lit("2024-01-02"))).count() == 1
    assert A.filter_lines(p, level="error").count() == 2 and A.filter_lines(p).count() == 4
    m = {r["m"]: r["d"] for r in p.select(*[c.alias(n) for c, n in zip(A.split_details(F.col("message")), "md")]).collect()}
    assert m["started"] == "3 files" and m["free text"] is None
    kinds = spark.createDataFrame([("Error_1.log",), ("collector.log",), ("x.log",)], "n string").select(A.log_kind(F.col("n")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["error", "collector", "general"]


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from corpusloom.sources import tables

    empty = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True))
    sc = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: empty))
    df = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.checkpoint(df)


def test_log_tail_goes_on_from_its_checkpoint(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()

    def run():
        q = streams.log_lines(spark, str(logs)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return spark.read.parquet(out)

    (logs / "a.log").write_text("[2024-01-02 03:04:05] INFO collector - started\nfree text\n")
    assert run().count() == 2
    (logs / "b.log").write_text("2024-01-02 03:04:06,000 - app.core - ERROR - failed\n")
    got = run()
    assert got.count() == 3 and got.where("level = 'ERROR'").first()["component"] == "app.core"


def test_monitor_counts_and_milestones(spark, tmp_path):
    assert streams.passed(0, 5, 10) == [25, 50] and streams.passed(5, 5, 10) == [] and streams.passed(5, 10, 10) == [75, 100] and streams.passed(0, 3, 0) == []
    src, seen = str(tmp_path / "in"), []
    make = lambda rows: spark.createDataFrame([(x,) for x in rows], "text string").coalesce(1).write.mode("append").parquet(src)
    make(["ok", "", None, "\ufffd\ufffd x"])

    def run():
        stream = spark.readStream.schema("text string").parquet(src)
        q = streams.monitor(stream, "text", 8, lambda now, m: seen.append((now, m)), trigger="0 seconds").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    run()
    make(["more"] * 4)
    run()
    assert seen[0] == ({"files": 4, "empty": 2, "damaged": 1, "percent": 50.0}, [25, 50]) and seen[-1][0] == {"files": 8, "empty": 2, "damaged": 1, "percent": 100.0} and 100 in seen[-1][1]


def test_auto_balance_sees_the_whole_corpus(spark, tmp_path):
    src, got = str(tmp_path / "in"), []
    spark.createDataFrame([("a",)] * 3, "domain string").write.parquet(src)
    corpus = spark.createDataFrame([(x,) for x in "abcdefgh" for _ in range(40)], "domain string")
    stream = spark.readStream.schema("domain string").parquet(src)
    q = streams.auto_balance(stream, "domain", lambda df, k: got.append({r["rule"] for r in df.collect()}), corpus=lambda: corpus, trigger="0 seconds").start()
    q.processAllAvailable()
    q.stop()
    assert got == [set()]


def test_near_duplicates_store_prefixes_only(spark, monkeypatch):
    """All pairs by brute force; of the shingles of a corpus a small part is stored."""
    import random
    import re

    from corpusloom.operators import near

    rng = random.Random(5)
    stock = [" ".join(rng.choices(["alpha", "Бета", "gamma_1", "d", "ñu", "中文", "x9"], k=6)) for _ in range(40)]
    rows = [(k, ". ".join(" ".join(f"w{rng.randrange(4000)}" for _ in range(20)) + " " + rng.choice(stock) for _ in range(8))) for k in range(150)]
    for k in range(30):
        w = rows[k][1].split(" ")
        w[rng.randrange(len(w))] = "other"
        rows.append((1000 + k, " ".join(w[: len(w) - k])))
    rows += [(2000 + k, rows[k][1].upper()) for k in range(4)] + [(3000 + k, rows[k][1]) for k in range(4)] + [(4000, None), (4001, "  "), (4002, "one two three"), (4003, "- ! -"), (4004, stock[0] * 3), (4005, stock[0] * 3 + " end")]
    sets, first = {}, {}
    for k, t in rows:
        if t and t.strip(" ") and t not in first:
            first[t] = k
            w = re.findall(r"\w+", t.lower())
            if len(w) > 4:
                sets[k] = {tuple(w[x : x + 5]) for x in range(len(w) - 4)}
    want = {(i, j): round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 6) for i in sets for j in sets if i < j}
    want = {p: v for p, v in want.items() if v >= 0.8}
    stored, inner = [], near.checkpoint

    def counted(df):
        out = inner(df)
        lists = [c for c, kind in out.dtypes if kind == "array<bigint>"]
        stored.append(sum(r[0] or 0 for c in lists for r in out.selectExpr(f"sum(size({c}))").collect()))
        return out

    monkeypatch.setattr(near, "checkpoint", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["i"], r["j"]): r["jaccard"] for r in near.pairs(df, "doc_id", "text").collect()}
    assert got == want and len(want) > 30
    assert stored and stored[0] < 0.4 * sum(map(len, sets.values()))


def test_texts_of_pairs_are_read_once(spark):
    """Only the texts of pairs reach the joins, not the table of documents."""
    from corpusloom.plans import literal_queries as L

    df = L.near_texts(spark, "/root/testdata/sf0.001")
    text = {r["doc_id"]: r["text"] for r in L.docs(spark, "/root/testdata/sf0.001").collect()}
    rows = df.collect()
    assert rows and all(r["a"] == text[r["i"]] and r["b"] == text[r["j"]] for r in rows)
    assert "FileScan" not in df._jdf.queryExecution().executedPlan().toString()
