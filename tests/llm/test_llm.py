"""Operators for training data: defined results of hard inputs, round trips and brute force on small tables."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import dup, garble, langmodel, language, leak, mix, prose, scan, subject, tokenize, unify
from corpusloom.llm import queries as Q

DIR = "/root/testdata/sf0.001"
LONG = "The order book thinned out near the touch, and volatility rose. " * 4000


def records(spark, texts, **more):
    rows = [(k, t, "en", f"host{k % 2}", f"/corpus/x/{k}.txt", "token_pricing", dt.datetime(2024, 1, 1), "clash", k, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "result_id long, text string, language string, source string, file_path string, domain string, ingested_at timestamp, key string, n long, kind string")


EDGE = [None, "", "   ", "\t\n", "word", "one two", "�", "x" * 100_000, LONG, LONG, "a b c d e f g. a b c d e f g."]


def test_all_operators_survive_edges_and_empty_tables(spark):
    for texts in (EDGE, []):
        r = records(spark, texts)
        hosts = spark.createDataFrame([("host0", "crawl")], "host string, kind string")
        config = spark.read.parquet(f"{DIR}/quality_config.parquet")
        keywords = spark.read.parquet(f"{DIR}/domain_keywords.parquet")
        assert garble.repair(r).count() == len(texts)
        assert prose.assess(r).count() == len(texts)
        assert language.classify(r, hosts).count() == len(texts)
        assert scan.repair(r).count() == len(texts)
        docs = r.withColumnRenamed("result_id", "doc_id")
        items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "The order book thinned out near the touch, and volatility rose.")], "item_id long, text string")
        assert unify.unify(docs).count() == len(texts)
        assert tokenize.encode_corpus(docs).count() == len(texts)
        leaks = {tuple(x) for x in leak.found(docs, items).collect()}
        assert leaks == ({(5, 3), (8, 4), (9, 4)} if texts else set())
        assert leak.found(docs, items.where("item_id < 0")).count() == 0
        pairs = {tuple(x) for x in dup.found(r).collect()}
        assert pairs == ({(8, 9)} if texts else set())
        assert subject.found(r, keywords).count() == 0 or texts
        assert subject.found(r, keywords.where("false")).count() == 0
        language.found(r, hosts, config).count()
        scan.found(r).count()
        assert mix.found(r, spark.read.parquet(f"{DIR}/domain_config.parquet")).count() >= 0


def test_tokens_of_long_texts_equal_the_whole(spark):
    enc = tokenize.encoding()
    random.seed(1)
    alphabet = ["word", "  ", " ", "\n", "don't", "12345", "é", "中文", "!!", " ", "<|endoftext|>", "a" * 50]
    for _ in range(200):
        t = " ".join(random.choice(alphabet) for _ in range(60)) + random.choice(alphabet)
        assert tokenize.encode(t, enc, limit=20) == enc.encode_ordinary(t)
    solid = ["字", "汉字", "。", "，", "a", "Zz", "é", "1", "23", "²", "'", "'s", "'ll", "-", "/", "+", "_", "=", "“", "×", "ß", "ж", "ｶ", "\u0301"]
    for _ in range(400):
        t = "".join(random.choice(solid) for _ in range(80))
        assert tokenize.encode(t, enc, limit=7) == enc.encode_ordinary(t)
    assert max(map(len, tokenize.pieces("汉字。" * 1000 + "aB3/" * 1000, 50))) < 60
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \t"), (4, "naïve 中文 <|endoftext|>"), (4, "again")], "doc_id long, text string")
    ids = {(r["doc_id"], tuple(r["ids"])) for r in tokenize.encode_corpus(docs).collect()}
    assert (1, ()) in ids and (2, ()) in ids and (3, tuple(enc.encode_ordinary(" \t"))) in ids and len(ids) == 5
    back = sorted((r["doc_id"], r["text"]) for r in tokenize.decode_corpus(tokenize.encode_corpus(docs)).collect())
    assert back == [(1, ""), (2, ""), (3, " \t"), (4, "again"), (4, "naïve 中文 <|endoftext|>")]


@pytest.mark.parametrize(
    ("good", "a", "b"),
    [
        ("Das größte Orderbuch prüfte “den” Abstand für 5 €.", "utf-8", "cp1252"), ("A negociação não é fácil — já se vê.", "utf-8", "mac_roman"), ("L’été à la plage, où?", "utf-8", "cp850"),
        ("Крупнейший поставщик объясняет риск больших потерь, хотя никто этого не ждал.", "koi8_r", "cp1251"), ("Крупнейший поставщик объясняет риск больших потерь, хотя никто этого не ждал.", "cp1251", "cp1252"),
        ("Крупнейший поставщик объясняет риск больших потерь, хотя никто этого не ждал.", "utf-8", "cp1251"), ("El comité aplazó la reducción según el análisis.", "cp1252", "cp1251"),
        ("这家交易平台自己承认低估了篮子中的权重，因为缺少需求。", "gb2312", "cp1252"), ("这家交易平台自己承认低估了篮子中的权重，因为缺少需求。", "utf-8", "latin1"),
    ],
)
def test_garbled_text_comes_back(good, a, b):
    bad = garble._bytes_as(good.encode(a), b)
    assert bad != good
    fixed, hits, _ = garble.repair_text(bad)
    assert hits > 0 and fixed == good
    mixed = "A sound sentence with “quotes” and São Paulo. " + bad
    fixed, hits, _ = garble.repair_text(mixed)
    assert hits > 0 and fixed.startswith("A sound sentence with “quotes” and São Paulo.")


GOOD = {
    "ko": "지난주에 발표된 보고서에 따르면 가격이 몇 퍼센트 올랐다고 합니다. 그것은 사실이 아니다.", "ja": "先週発表された報告書によると、価格は数パーセント上昇したということです。これは良いです。",
    "el": "Η επιτροπή ανακοίνωσε ότι η τιμή των προϊόντων και του πετρελαίου αυξήθηκε στην αγορά από την αρχή.", "pl": "Komisja stwierdziła, że ceny są wysokie i mogą być jeszcze większe, bo się zmieniają.",
    "tr": "Bu karar için değil, olduğu gibi kalması için şimdi başka bir şey yapıldı.", "zht": "這家公司的交易平台在我們國家是最大的，因為他們有很多的用戶和市場。", "zh": "这家交易平台自己承认低估了篮子中的权重，因为缺少需求。",
    "cs": "Komise uvedla, že ceny jsou vysoké a může být také další růst, který však není jistý.", "de": "Die Kommission prüfte für den Ausschuss über die Größe, während später alles möglich würde.",
    "fr": "La commission a également été très à même de déjà dire où être après.", "ru": "Крупнейший поставщик объясняет риск больших потерь, хотя никто этого не ждал.",
}
READ = "ko euc_kr latin1,ko euc_kr cp1252,ko utf-8 cp1252,ko utf-8 latin1,ja shift_jis cp1252,ja euc_jp latin1,ja utf-8 cp1252,el utf-8 cp1252,el cp1253 cp1252,el iso8859_7 latin1,pl utf-8 cp1252,pl cp1250 cp1252,pl iso8859_2 latin1,tr cp1254 cp1252,tr utf-8 cp1252,zht big5 cp1252,zht big5 latin1,zht utf-8 cp1252,zh gb2312 mac_roman,zh gbk cp850,cs utf-8 latin1,de mac_roman cp1252,de cp850 cp1252,de cp1252 mac_roman,fr cp1252 cp850,fr mac_roman cp1252,ru koi8_r cp1251,ru cp866 cp1252,ru mac_cyrillic cp437".split(",")


@pytest.mark.parametrize("case", READ)
def test_pairs_of_other_languages(case):
    lang, a, b = case.split()
    bad = garble._bytes_as(GOOD[lang].encode(a), b)
    fixed, hits, _ = garble.repair_text(bad)
    assert fixed == GOOD[lang] and hits > 0


def test_nothing_is_replaced_without_proof():
    for t in GOOD.values():
        assert garble.repair_text(t)[0] == t
    for bad in (garble._bytes_as("příliš".encode("cp1250"), "cp1252"), garble._bytes_as("가격".encode("euc_kr"), "latin1")):
        assert garble.repair_text(bad)[0] == bad  # too little to tell


def test_quick_check_never_says_no_for_text_with_hits():
    for case in READ:
        lang, a, b = case.split()
        assert garble.suspect("A sound sentence first. " + garble._bytes_as(GOOD[lang].encode(a), b))


@pytest.mark.parametrize("text", ["ATENÇÃO: AVALIAÇÃO PRELIMINAR. SÃO DUAS VERSÕES.", "Ёлка и ещё одна. Всё сразу.", "σβ and √2 ≥ 1", "Zéphithor “note” — €5", "risque très élevé, déjà créée", "НОВЫЙ ОТЧЁТ О РЫНКЕ", "liqu¬\nidity"])
def test_sound_text_stays(text):
    assert garble.repair_text(text)[:2] == (text, 0)


def test_unify_is_idempotent_and_leaves_sound_text():
    for same in ["x\u0304 y", "e\u0323\u0301", "\u0437\u0430\u0301\u043c\u043e\u043a"]:  # marks that no composed letter has stay
        fixed, kinds = unify.unify_text(same)
        assert fixed == __import__("unicodedata").normalize("NFC", same) and kinds == ["combining"] and unify.unify_text(fixed)[0] == fixed
    for same in ["\U0001f468\u200d\U0001f469\u200d\U0001f467", "\u0645\u06cc\u200c\u062e\u0648\u0627\u0647\u0645", "k\u03a9 \u03bcm", "\u2764\ufe0f"]:  # joiners in emoji and Persian, units
        assert unify.unify_text(same) == (same, [])
    for x, y in {"\u212b": "\u00c5", "\u2126": "\u03a9", "\ufb01ne": "fine", "\uff76\uff9e": "\u30ac", "\u1112\u1161\u11ab": "\ud55c", "\u0441\u043e\u0441\u043e a": "coco a"}.items():
        fixed, kinds = unify.unify_text(x)
        assert fixed == y and kinds and not set(kinds) & set(unify.CASES) and unify.unify_text(fixed) == (y, [])
    texts = ["plain", "caf\u00e9", "cafe\u0301", "a\u00a0b", "p\u0430y", "\u041f\u0440\u0438\u0432\u0435\u0442", None, "\u212b", "\u0441\u043e\u0441\u043e"]
    assert unify.suspects(texts).tolist() == [False, False, True, True, True, False, False, True, True]
    bad = {"Ｆｕｌｌ １２": "Full 12", "café": "café", "zero​width": "zerowidth", "a b c": "a b c", "pаypаl": "paypal", "оrдер": "оrдер"}
    for x, y in list(bad.items())[:5]:
        fixed, kinds = unify.unify_text(x)
        assert fixed == y and kinds and unify.unify_text(fixed) == (y, [])
    for t in ["（你好），世界。", "Привет, мир", "“quotes” — dashes…", "βσ = 2", "São tomé", "tab\tline\n", "在Drosand交易"]:
        assert unify.unify_text(t) == (t, [])


PROSE = ["The committee of the fund asked whether the order book was really thin, and it was not.", "In the end, two of them left because the price of the token had not moved at all.", "When the auction was over, we saw that most of the orders had been placed by one desk.", "It is hard to say how much of this was due to the new rule, but some of it surely was."]


def corpus_with(spark, odd):
    random.seed(3)
    sound = [" ".join(random.choice(PROSE) for _ in range(random.randint(3, 9))) + f" {k} of them." for k in range(200)]
    return records(spark, odd + sound)


ODD = {
    "list": ["\n".join(f"- thin order {x}" for x in "abcdefgh"), "; ".join(f"narrow limit {x * 5}" for x in "abcdefghijk"), "\n".join(f"{k}. quiet market {x * 4}" for k, x in enumerate("abcdefgh", 1))],
    "table": ["a | b | c | d\n" + "\n".join(f"x{k} | {k} | {k + 1} | {k * 7}" for k in range(8)), "\n".join(f"name{k}\t{k * 3}\t{k * 7}\t{k}" for k in range(9))],
    "junk": ["=@}~# +##=]=*/< #$ #<%|{/#_| }$<" * 3, "loading krfc loading loading krfc loading " * 10, "zq xv kkw prr tlm bvx qqz wrt pls mnb " * 3, "== -- !!"],
}
LATE = "\n".join(["#### ----", "+---+---+---+"] * 30) + "\n" + "\n".join(f"x{k} | +++ | --- | %%% {k}" for k in range(200))


def test_distance_and_contributions_tell_kinds(spark):
    """Also a long table whose rows begin late. Without the distance (an endless cut-off) nothing is told."""
    odd = [(k, t) for k, ts in ODD.items() for t in ts] + [("table", LATE)]
    short = "We looked at the list again, and this is what was on it:\n- thin order a\n- thin order b\nNone of it was new to us, and so we left it there."
    r = corpus_with(spark, [t for _, t in odd] + [short, None, "  "])
    got = {x["result_id"]: x["kind"] for x in prose.found(r).collect()}
    assert got == {i: k for i, (k, _) in enumerate(odd)}


def test_kinds_need_the_distance(spark, monkeypatch):
    r = corpus_with(spark, ODD["list"])
    monkeypatch.setattr(prose, "CUT", 1e9)
    stats = prose.statistics(r)
    model = prose.fit(stats)
    c, diff = prose.contributions(np.array([[0.0] * len(prose.DIMS)]), np.array(["en"]), model)
    assert prose.kinds_of(c, diff).tolist() == [None]
    monkeypatch.setattr(prose, "CUT", 80.0)
    assert prose.kinds_of(c, diff).tolist() != [None]


def test_few_records_give_no_fit(spark):
    r = records(spark, ODD["list"] + ["== -- !!"])
    assert [tuple(x) for x in prose.found(r).collect()] == [(3, "junk")]


def test_statistics_equal_plain_python():
    texts = ["One two, three. Four", "a-b c's  ÀB 12\n\n(x)!", None, " \n", "wörter wörter, ￼ 3.5% — ok?”", "x" * 5000 + " y"]
    m = prose.measure(texts)
    for t, r in zip(texts, m.to_dict("records")):
        if not t or not t.strip():
            assert r["word_count"] is None or pd.isna(r["word_count"])
            continue
        w = ["".join(c for c in p.lower() if c.isalnum()) for p in t.split()]
        w = [x for x in w if x]
        solid = sum(not c.isspace() for c in t)
        assert r["word_count"] == len(w) and r["word_length"] == pytest.approx(sum(map(len, w)) / len(w))
        assert r["symbol_ratio"] == pytest.approx((solid - sum(map(len, w))) / solid) and r["distinct_share"] == pytest.approx(len(set(w)) / len(w))
        lines = [x.strip() for x in t.split("\n") if x.strip()]
        assert r["line_end_punct"] == pytest.approx(sum(x.rstrip("\"'”)")[-1:] in tuple(".!?") for x in lines) / len(lines))


def test_distance_contributions_sum_up(spark):
    a = prose.assess(spark.read.parquet(f"{DIR}/extraction_results.parquet")).where("distance is not null").toPandas()
    assert ((a["contributions"].map(sum) - a["distance"]).abs() < 1e-3 * (1 + a["distance"])).all()
    assert a.loc[a["kind"].notna(), "outlier"].all()


@pytest.mark.parametrize(("text", "lang"), [("The report was published and it is not final.", "en"), ("Das ist nicht der Bericht und er wird geprüft.", "de"), ("Le rapport est dans la section et il ne change pas.", "fr"), ("El informe no es el último y se publica con los datos.", "es"), ("O relatório não é o último e foi publicado com os dados.", "pt"), ("Это новый отчёт о рынке", "ru"), ("这是新的报告", "zh")])
def test_languages(text, lang):
    assert langmodel.best(text)[0] == lang


def test_mixed_and_wrong_labels(spark):
    en, de = "The report was published and it is not final in any way. ", "Das ist nicht der Bericht und er wird noch im Herbst geprüft. "
    rows = [(1, en * 5, "de"), (2, en * 5, "English"), (3, en * 3 + de * 3, "en"), (4, de * 5, None), (5, en * 9 + de, "en"), (6, en * 5, "und"), (7, de * 4, "de-AT")]
    r = spark.createDataFrame([(i, t, g, "h", "/x") for i, t, g in rows], "result_id long, text string, language string, source string, file_path string")
    hosts = spark.createDataFrame([("h", "k")], "host string, kind string")
    got = {tuple(x) for x in language.found(r, hosts, spark.read.parquet(f"{DIR}/quality_config.parquet")).collect()}
    assert got == {(1, "en"), (3, "en"), (3, "de"), (4, "de"), (6, "en")}


def test_priors_decide_what_the_text_leaves_open(spark):
    """The same short text is German on a host and under a label of German texts; without priors it is not."""
    de, en = "Das ist nicht der Bericht und er wird noch im Herbst geprüft. ", "The report was published and it is not final in any way. "
    rows = [(k, de * 3, "de", "h1") for k in range(60)] + [(100 + k, en * 3, "en", "h2") for k in range(60)]
    short = "x 7"
    rows += [(500, short, None, "h1"), (501, short, None, "h2"), (502, "12345", None, "h1")]
    r = spark.createDataFrame([(i, t, g, h, "/x") for i, t, g, h in rows], "result_id long, text string, language string, source string, file_path string")
    hosts = spark.createDataFrame([("h1", "a"), ("h2", "b")], "host string, kind string")
    got = {x["result_id"]: (x["lang"], x["confidence"]) for x in language.classify(r, hosts).where("result_id >= 500").collect()}
    assert got[500][0] == "de" and got[501][0] == "en" and got[502] == (None, 0.0)
    assert 0 < got[500][1] <= 1


def test_languages_beyond_the_nine_are_no_case(spark):
    pl = "Zgodnie z raportem, który został opublikowany w zeszłym tygodniu, ceny wzrosły o kilka procent. "
    r = spark.createDataFrame([(1, pl * 3, "pl", "h", "/x"), (2, pl, None, "h", "/x")], "result_id long, text string, language string, source string, file_path string")
    hosts = spark.createDataFrame([("h", "k")], "host string, kind string")
    assert {x["lang"] for x in language.classify(r, hosts).collect()} == {"und"}
    assert language.found(r, hosts, spark.read.parquet(f"{DIR}/quality_config.parquet")).count() == 0


def test_words_counted_by_arrays_equal_plain_ones():
    from collections import Counter

    texts = ["The liqui-\ndity of A1 and 12 or don't_do  x", "the The THE", "", "é" * 50 + " ab abc", "Straße İstanbul 中文字 １２３"]
    for by_text in (True, False):
        want, got = Counter(), Counter()
        for t in texts:
            want.update((set if by_text else list)(scan.tokens(t)))
        for w, n in scan.count_words(texts, by_text):
            got[w] += n
        assert got == want


def test_scan_repair():
    wrong, keep = {"diffcrence": "difference", "tbe": "the"}, {"cap-weighted": False}
    text = "Acme Desk Bulletin\np. 9\nIn tbe sample, the liqui-\ndity and the cap-\nweighted index show a\np. 10\nAcme Desk Bulletin\nbig diffcrence.\n\nNext one."
    fixed, pages, divided, misread = scan.mend(text, wrong, keep)
    assert fixed == "In the sample, the liquidity and the cap-weighted index show a big difference.\n\nNext one."
    assert (pages, divided, misread) == (4, 1, 2)
    assert scan.mend("Only broken\ninto lines.", wrong, keep) == ("Only broken into lines.", 0, 0, 0)


def test_scan_corrections_by_join_equal_the_local_ones(spark, monkeypatch):
    words = [f"the difference of the model was improved when the well desk measured it again for the sample {k}" for k in range(60)]
    words += ["it was a wcll-known thing", "no wcll-known thing at all"]
    r = records(spark, words + ["the diffcrence of the rnodel vvas iinproved", "the wcll-\nknown thing and the diffcr-\np. 9\nence of it"])
    a = sorted(map(tuple, scan.repair(r).collect()))
    monkeypatch.setattr(scan, "MAX_LOCAL", 0)
    b = sorted(map(tuple, scan.repair(r).collect()))
    assert a == b and "the difference of the model was" in a[-2][1]
    assert a[-1][1] == "the well-known thing and the difference of it"


def test_scan_corrections_count_copies_of_a_text_once(spark):
    sound = [f"the difference of the model was improved when desk {k} measured it again for the sample" for k in range(60)]
    bad = "the diffcrence of the rnodel vvas iinproved"
    r = records(spark, sound + [bad] * 40)  # its misreadings are more frequent than a twentieth of the true words
    fixed = scan.repair(r.union(r.where(F.col("text") == bad))).where("result_id >= 60").collect()
    assert len(fixed) == 80 and all(x["damaged"] and x["text"].startswith("the difference of the model was") for x in fixed)


@pytest.mark.parametrize(("tokens", "local"), [(None, None), (40, 0)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, tokens, local):
    """Also where every bucket is crowded and cut into blocks, and where the texts of candidates are shuffled."""
    if tokens:
        monkeypatch.setattr(dup, "BUCKET_TOKENS", tokens)
        monkeypatch.setattr(dup, "MAX_LOCAL", local)
    random.seed(5)
    vocab = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(60):
        base = [random.choice(vocab) for _ in range(random.randint(5, 120))]
        texts.append(" ".join(base))
        for _ in range(random.randint(0, 3)):
            x = list(base)
            for _ in range(random.randint(0, max(1, len(x) // 8))):
                x[random.randrange(len(x))] = random.choice(vocab)
            texts.append(" ".join(x))
    texts += ["copy of one text"] * 40 + ["a", "a", "", None]
    r = records(spark, texts)
    got = {tuple(x) for x in dup.found(r.union(r.limit(30))).collect()}
    sets = [set(dup.sequences([t])[0].tolist()) if t else set() for t in texts]
    want = set()
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            u = len(sets[i] | sets[j])
            if texts[i] and (texts[i] == texts[j] or u and len(sets[i] & sets[j]) / u >= 0.5):
                want.add((i, j))
    assert got == want
    g = dup.groups(r).toPandas().set_index("result_id")["group_id"]
    assert all(g[i] == g[j] for i, j in want)
    assert len(g) == sum(bool(t) for t in texts)


def test_paths_are_joined_in_rounds(spark, monkeypatch):
    """Where paths are cut into many buckets, no join shuffles more than a part of all stretches; the pairs stay the same."""
    random.seed(6)
    vocab = [f"w{k}" for k in range(40)]
    bases = [[random.choice(vocab) for _ in range(90)] for _ in range(40)]
    texts = [" ".join(b) for b in bases] + [" ".join(b[k % 9 :] + ["end"]) for k, b in enumerate(bases)]
    r = records(spark, texts)
    r = r.union(r).repartition(5)  # copies in several batches
    want = {tuple(x) for x in dup.found(r).collect()}
    sets = [set(dup.sequences([t])[0].tolist()) for t in texts]
    assert want == {(i, j) for i in range(80) for j in range(i + 1, 80) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5} and len(want) >= 40
    rows, inner = [], dup.candidates

    def counted(packs, *rest):
        x = [(p["bucket"], p["key"][k : k + 16]) for p in packs.where("i = j").collect() for k in range(0, len(p["key"]), 16)]
        rows.append(len(x))
        assert len(set(x)) == len(x)  # copies have one path
        return inner(packs, *rest)

    monkeypatch.setattr(dup, "candidates", counted)
    monkeypatch.setattr(dup, "BUCKET_TOKENS", 100)
    monkeypatch.setattr(dup, "LEAST_ROUND", 0, raising=False)
    assert {tuple(x) for x in dup.found(r).collect()} == want
    assert len(rows) > 2 and max(rows) <= 0.5 * sum(rows)


def test_each_part_of_the_prefix_tree_finds_pairs_of_its_own():
    """Without the pairs of one branch, or without those across branches, pairs are lost; bounds lose none."""
    random.seed(8)
    base = [random.randrange(1, 10**6) for _ in range(30)]
    rows = []
    for k in range(40):
        path = sorted(set(random.sample(base, 20)))
        rows.append((k, 40, path))
    part = pd.DataFrame({"n": [r[1] for r in rows], "tok": [np.array(r[2], np.uint32).tobytes() for r in rows], "pos": [0] * len(rows), "parity": [bytes(64)] * len(rows)})
    all_pairs = {tuple(p) for p in dup.bucket_pairs(part).tolist()}
    need = {(i, j) for i in range(40) for j in range(i + 1, 40) if len(set(rows[i][2]) & set(rows[j][2])) >= 27}
    assert need <= all_pairs
    tree = dup.Tree(part["n"].to_numpy(), part["tok"].tolist(), part["pos"].to_numpy())
    own = [len(x) for x, _ in tree.below()]
    other = [len(x) for x, _ in tree.across()]
    assert sum(own) and sum(other)
    shared = tree.start[:, 0]
    assert all((shared[x] == shared[y]).all() for x, y in tree.below())


def test_latest_delivery_gives_the_text(spark):
    at = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    a, b = "one two three four five", "six seven eight nine ten"
    r = spark.createDataFrame([(1, a, at[0]), (1, b, at[1]), (2, a, at[0]), (3, b, at[0]), (3, b, at[1])], "result_id long, text string, ingested_at timestamp")
    assert [tuple(x) for x in dup.found(r).collect()] == [(1, 3)]


def test_leaks_equal_brute_force(spark):
    random.seed(6)
    vocab = [f"w{k}x" for k in range(300)]
    items = [(k, " ".join(random.choice(vocab) for _ in range(60))) for k in range(12)] + [(90, "too short"), (91, None)]
    docs = []
    for k in range(80):
        words = [random.choice(vocab) for _ in range(80)]
        it = items[k % 12][1].split()
        n = random.choice([0, 4, 12, 20, 25, 30, 60])
        a = random.randint(0, 60 - n)
        docs.append((k, " ".join(words[:30] + it[a : a + n] + words[30:])))
    got = {tuple(x) for x in leak.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for d, t in docs:
        have = leak.sequences(leak.plain(t).split())
        for i, q in items[:12]:
            s = leak.sequences(leak.plain(q).split())
            if len(s & have) * 3 >= len(s):
                want.add((d, i))
    assert got == want and want


def test_leaks_of_a_smaller_share(spark):
    words = [f"w{k}x" for k in range(60)]
    doc = [f"y{k}z" for k in range(40)] + words[10:22] + [f"z{k}y" for k in range(40)]  # 8 of 56 sequences
    got = leak.leaks(spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string"), spark.createDataFrame([(2, " ".join(words))], "item_id long, text string"), share=0.1)
    assert [(r["doc_id"], r["item_id"], r["shared"]) for r in got.collect()] == [(1, 2, 8)]


def test_alignment_equals_plain_edit_distance():
    random.seed(4)

    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(last + (x != y), d[j] + 1, d[j - 1] + 1)
        return d[-1]

    for _ in range(200):
        a = "".join(random.choice("ab c") for _ in range(random.randint(1, 30)))
        b = list(a)
        for _ in range(random.randint(0, 4)):
            k = random.randrange(len(b) + 1)
            b[k : k + random.randint(0, 1)] = random.choice(["", "x", "a"])
        b = "".join(b) or "a"
        assert leak.align(leak.bulk.codes_of(b), leak.bulk.codes_of(a), 10) == plain(a, b)


def test_plain_words_equal_plain_python():
    for t in ["  One,  two\n\nthree! ", "", "a--b  c", " . ", "x", "Ünï_code 12\t3"]:
        want = " ".join(w for w in ("".join(c for c in p.lower() if c.isalnum()) for p in t.split()) if w)
        assert leak.plain(t) == want
    codes, starts = leak.plain_codes(["a b", None, " c. "])
    assert leak.text_of(codes) == "a b\n\nc\n" and starts.tolist() == [0, 4, 5, 7]


def test_alignment_decides(spark, monkeypatch):
    """Edits spread over a passage leave few whole sequences: the alignment alone reports it, in each of its places. Where
    nothing aligns, nothing is found."""
    random.seed(9)
    words = [f"{random.choice('bcdfg')}{k}{random.choice('aeiou')}vwx{k * 7}" for k in range(60)]
    changed = [w[:-1] + "Q" if k % 4 == 0 else w for k, w in enumerate(words)]
    filler = [f"y{k}z" for k in range(50)]
    docs = spark.createDataFrame([(1, " ".join(filler + changed + filler)), (2, " ".join(words[:30] + filler + words[30:])), (3, " ".join(filler))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r["doc_id"]: r for r in leak.leaks(docs, items).collect()}
    assert set(got) == {1, 2} and got[1]["share"] < 1 / 3 and got[1]["similarity"] > 0.9 and len(got[2]["passages"]) >= 2
    assert {r["doc_id"] for r in leak.found(docs, items).collect()} == {2}
    index = leak.Index([(7, " ".join(words))])
    texts = [r["text"] for r in docs.collect()]
    assert {d for d, *_ in leak.verified(index, texts)} == {0, 1}
    monkeypatch.setattr(leak, "align", lambda *a: 10**6)
    index.cover[:] = 10**6
    monkeypatch.setattr(leak, "BUDGET", -1e9)
    assert not leak.verified(index, texts)


def test_many_items_and_short_texts_take_no_table_of_pairs():
    import tracemalloc

    items = [(k, f"alpha{k} beta{k * 3} gamma{k * 7} delta{k * 11} eps{k * 13} zeta{k * 17}") for k in range(2_000)]
    index = leak.Index(items)
    texts = [f"alpha{k} beta{k * 3} gamma{k * 7} delta{k * 11} eps{k * 13} zeta{k * 17} end" for k in range(1_000)]
    tracemalloc.start()
    got = leak.verified(index, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(d, k) for d, k, *_ in got} >= {(k, k) for k in range(1_000)} and peak < 100e6


def test_mix_shares_and_limits(spark):
    rows = [(k, "x" * 100, "A", dt.datetime(2024, 1, 1)) for k in range(100)] + [(200 + k, "y" * 100, " b ", dt.datetime(2024, 1, 1)) for k in range(5)] + [(1, "x" * 100, "A", dt.datetime(2024, 2, 1)), (300, " ", "A", None), (301, "z", "other", None)]
    r = spark.createDataFrame(rows, "result_id long, text string, domain string, ingested_at timestamp")
    c = spark.createDataFrame([("a", 0.5, 2, 100), ("b", 0.5, 3, 6), ("none", 0.0, 1, None)], "domain string, target_weight double, max_repeats int, min_documents int")
    m = {x["domain"]: x for x in mix.report(r, c).collect()}
    assert m["b"]["too_few"] and not m["a"]["too_few"] and not m["none"]["too_few"]
    assert m["b"]["short"] and m["b"]["planned_chars"] == 1500 and m["a"]["planned_chars"] == 9000 and m["none"]["planned_chars"] == 0
    d = mix.draw(r, c).toPandas()
    assert len(d) == 105 and d.loc[d.domain == "b", "repeats"].eq(3).all() and d.loc[d.domain == "a", "repeats"].between(0, 2).all()
    assert [x["domain"] for x in mix.found(r, c).collect()] == ["b"]


def test_queries_with_sql(spark):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{DIR}/{f}')")
    for name, sql in Q.oracle_sql().items():
        got = Q.queries()[name](spark, DIR).toArrow().to_pylist()
        want = con.execute(sql).to_arrow_table().to_pylist()
        assert sorted(map(repr, (sorted(r.items()) for r in got))) == sorted(map(repr, (sorted(r.items()) for r in want))), name


def test_every_query_runs(spark):
    for name, q in Q.queries().items():
        df = q(spark, DIR)
        assert df.columns and df.count() >= 0, name


def test_subjects_of_clear_texts(spark):
    found = subject.subjects(spark.read.parquet("/root/testdata/sf0.01/extraction_results.parquet"), spark.read.parquet("/root/testdata/sf0.01/domain_keywords.parquet")).toPandas()
    assert isinstance(found, pd.DataFrame) and found["share"].between(0.2, 1.0).all()
    r = spark.read.parquet("/root/testdata/sf0.01/extraction_results.parquet").select("result_id", F.lower("domain").alias("d")).distinct().toPandas()
    j = found[found["share"] > 0.6].merge(r[r["d"].isin(found["domain"].unique())])
    assert (j["d"] == j["domain"]).mean() > 0.8  # most recorded domains are right


def test_leaves_decide_the_subjects(spark):
    """Clustering decides the rows: two leaves can't tell eight subjects apart, whatever the keywords."""
    r, keywords = spark.read.parquet("/root/testdata/sf0.01/extraction_results.parquet"), spark.read.parquet("/root/testdata/sf0.01/domain_keywords.parquet")
    few, many = (set(map(tuple, subject.subjects(r, keywords, leaves=k).select("result_id", "domain").collect())) for k in (2, subject.LEAVES))
    assert len(many) > 500 and len(few & many) < len(many) / 2


def test_terms_of_sentences():
    got = subject.sentence_terms(["The small order of Karvo was in the book. It was not the small order, and that is what it was.", "Das ist nicht der Bericht.", None])
    assert got[1] is None and got[2] is None
    terms, ends = got[0]
    assert len(ends) == 2 and subject.keyword_terms("small order")[0] in terms[: ends[0]] and subject.keyword_terms("small order")[0] in terms[ends[0] :]
    assert subject.keyword_terms("term structure of futures") == subject.keyword_terms("term structure") and subject.keyword_terms("the of") == []


def test_subject_leaves_are_fitted_on_all_distinct_documents(spark, monkeypatch):
    from pyspark.ml.clustering import BisectingKMeans

    seen, fit = [], BisectingKMeans.fit
    monkeypatch.setattr(BisectingKMeans, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    r = spark.read.parquet("/root/testdata/sf0.01/extraction_results.parquet").where("text is not null")
    tail = F.element_at(F.array(*[F.lit(x) for x in ("alpha", "beta", "gamma", "delta", "kappa", "sigma")]), F.col("k").cast("int") + 1)
    many = r.crossJoin(spark.range(6).withColumnRenamed("id", "k")).withColumn("text", F.concat("text", F.lit(" The report was about "), tail, F.lit(" of the market.")))
    many = many.withColumn("result_id", F.col("result_id") * 10 + F.col("k"))
    keywords = spark.read.parquet("/root/testdata/sf0.01/domain_keywords.parquet")
    subject.subjects(many, keywords)
    subject.subjects(many.unionByName(many.limit(1).crossJoin(spark.range(2000)).drop("id")), keywords)  # a hot group of copies
    assert seen[0] > 4000 and seen[0] == seen[1]
