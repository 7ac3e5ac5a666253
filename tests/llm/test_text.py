import hashlib
import random
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quarrymill.llm import bpe, crf_html, ecoc_lang, ftrl, merkle
from quarrymill.llm.template_decontam import decontaminate
from quarrymill.session import Scratch

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coders():
    ranks = bpe.load_ranks(RANKS)
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(coders, rows):
    ours, theirs = coders
    rng = random.Random(3)
    parts = ["a", "the", "  ", " ", "\n", "é", "ß", "12", "'s", "===", "日本", "🎉", "\t", "aaaa", "ing", " ", "\r\n"]
    texts = [t for _, t in rows if t] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["".join(rng.choice(["a", "aa", "b", "th"]) for _ in range(700)), "=" * 3000, "<|endoftext|> x"]
    for ids, t in zip(ours.encode(texts), texts):
        assert ids.tolist() == theirs.encode_ordinary(t)


def test_bpe_join_is_associative(coders):
    ours, _ = coders
    data = "unbelievablyinternationalisation".encode()
    for i in range(1, len(data) - 1):
        for j in range(i + 1, len(data), 5):
            a, b, c = (ours.reduce(x) for x in (data[:i], data[i:j], data[j:]))
            assert ours.join(ours.join(a, b), c) == ours.join(a, ours.join(b, c)) == ours.merge(data)
    assert ours.join([], ours.reduce(data)) == ours.reduce(data) == ours.join(ours.reduce(data), [])


def test_bpe_round_trip(docs, rows, odd, empty):
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert all(bytes(got[i]["decoded"]) == (t or "").encode() for i, t in rows)
    assert got[100]["ids"] == [] and bpe.encode_decode(odd, RANKS, public_tokenizers.PATTERN).count() == 6
    assert bpe.encode_decode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_leaks_are_found_and_clean_documents_left(spark, empty):
    item = "We know Tom bought 12 apples for 3 dollars and then sold 5 apples to Anna in the market on the corner. How many apples does Tom have left now?"
    data = [
        (1, "Before it. " + item + " After it."),
        (2, "Now Bob bought 7 apples for 9 dollars and then sold 2 apples to Eve in the market on the corner. How many apples does Bob have left now?"),
        (3, "An apple was sold in the market on the corner by someone who knew nothing of this question at all."),
        (4, None), (5, ""), (None, item), (6, item), (6, item),
    ]
    bench = spark.createDataFrame([(0, item), (1, "too short"), (2, None), (None, "a b c d e f")], "item_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["contaminated"], r["item_ids"]) for r in decontaminate(spark.createDataFrame(data, "doc_id long, text string"), bench).collect())
    assert got == [(0, False, []), (1, True, [0]), (2, True, [0]), (3, False, []), (4, False, []), (5, False, []), (6, True, [0]), (6, True, [0])]
    assert decontaminate(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate(spark.createDataFrame(data, "doc_id long, text string"), bench.where("false")).collect())


def test_slots_must_agree(spark):
    item = "Tom gave Ann 3 red balls and Tom gave Sue 4 red balls so Tom has 5 red balls"
    clash = "Bob gave Eve 3 red balls and Jim gave Kim 4 red balls so Pat has 5 red balls"
    bench = spark.createDataFrame([(0, "x " + item)], "item_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate(spark.createDataFrame([(1, "x " + item), (2, "x " + clash)], "doc_id long, text string"), bench).collect()}
    assert got == {1: True, 2: False}


def test_leaks_in_another_case_or_with_longer_names(spark):
    items = [
        "We read that a train leaves Boston at 9 am for New York and that another one leaves New York for Boston at 10 am with Alice Smith on board. When do Alice Smith and Bob meet?",
        "This morning Janet sells 16 eggs to Mark and Lucy at the market while Peter sells 12 eggs to Nancy and Oscar. How many eggs do Janet and Peter sell?",
    ]
    longer = items[1]
    for one, two in (("Janet", "Mary Ann"), ("Mark", "John Paul"), ("Lucy", "Eva Maria"), ("Peter", "Carl Otto"), ("Nancy", "Anna Lena"), ("Oscar", "Hans Peter")):
        longer = longer.replace(one, two)
    clash = longer.replace("do Mary Ann and Carl Otto", "do Rosa Lee and Kim Jong").replace("while Carl Otto", "while Mary Ann").replace("John Paul and Eva Maria", "Hans Peter and Hans Peter")
    other = "This morning the farmer walked to the market while his friends sold many eggs and then went home to read a book about trains."
    texts = [f(x) for x in items for f in (str, str.lower, str.upper, str.title)] + [longer, longer.lower(), other]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["item_ids"], r["share"]) for r in decontaminate(docs, bench).collect()}
    assert all(got[i] == ([i // 4], 1.0) for i in range(8)) and got[8] == ([1], 1.0)
    assert got[10] == ([], 0.0)
    lower = spark.createDataFrame([(i, x.lower()) for i, x in enumerate(items)], "item_id long, text string")
    assert all(r["item_ids"] == [r["doc_id"] // 4] for r in decontaminate(docs.where("doc_id < 8"), lower).collect())
    assert {r["doc_id"]: r["contaminated"] for r in decontaminate(spark.createDataFrame([(0, clash)], "doc_id long, text string"), bench).collect()} == {0: False}


LANGS = {"aa": ["the", "and", "thing", "with", "was"], "bb": ["der", "und", "ein", "nicht", "schon"], "cc": ["les", "une", "que", "pas", "être"]}


def labelled(seed=5, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        bad = rng.random() < 0.3
        text = [rng.choice(LANGS[lang]) for _ in range(rng.randint(5, 40))]
        if bad:
            text.insert(rng.randrange(len(text)), "idiot")
        out.append((i, " ".join(text), lang, int(bad)))
    return out


def test_language(spark, odd, empty):
    data = labelled()
    docs = spark.createDataFrame([(i, t, g) for i, t, g, _ in data] + [(1000, None, "aa"), (1001, "123 !!", "aa"), (1002, "the thing", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in ecoc_lang.language_id(docs).collect()}
    held = [i for i, *_ in data if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held) and sum(r["held_out"] for r in got.values() if r["doc_id"] < 1000) == len(held)
    assert sum(got[i]["lang_pred"] == data[i][2] for i in held) >= 0.97 * len(held)
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1002]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert ecoc_lang.language_id(empty).count() == 0
    from pyspark.sql import functions as F

    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in ecoc_lang.language_id(unlabelled).collect()} == {"und"}


def test_codewords_are_apart():
    for n in (2, 4, 5, 12):
        code = ecoc_lang.codewords(n)
        least = min(int((code[a] != code[b]).sum()) for a in range(n) for b in range(a))
        assert least >= (1 if n == 2 else code.shape[1] // 3)
    model = ecoc_lang.Model(["a", "b", "c", "d"], ecoc_lang.codewords(4), None, ecoc_lang.np.ones(7) / 7)
    wrong = model.code[2].astype(float) * 3
    wrong[0] *= -1
    assert int(ecoc_lang.decode(wrong, model).argmax()) == 2


def test_toxicity(spark, odd, empty):
    data = labelled(7, 600)
    docs = spark.createDataFrame([(i, t, "zz") for i, t, _, _ in data] + [(1000, None, "zz"), (1001, "", "zz")], "doc_id long, text string, label string")
    marks = spark.createDataFrame([(i, y) for i, _, _, y in data] + [(None, 1), (5000, 1), (1000, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in ftrl.toxicity(docs, marks).collect()}
    held = [i for i, *_ in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} >= set(held)
    assert sum(got[i]["predicted"] == data[i][3] for i in held) >= 0.97 * len(held)
    assert 0 <= got[1000]["score"] == got[1001]["score"] <= 1
    assert ftrl.toxicity(empty, marks).count() == 0 and ftrl.toxicity(odd, marks.where("false")).count() == 6


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i % 7}", "<p>" + "y" * (i % 50)) for i in range(300)] + [(None, None, None), (5, "http://x/5", "<p>" + "y" * 5)], "page_id long, url string, html string")
    scratch = Scratch(spark)
    ours = scratch.table(merkle.archive(pages, file_records=60), "ours")
    by_file = {}
    for r in ours.orderBy("file", "place").collect():
        assert r["offset"] == by_file.get(r["file"], 0) and r["length"] == len(r["record"].encode())
        by_file[r["file"]] = r["offset"] + r["length"]
    assert merkle.fixity_audit(ours, ours).count() == 0
    from pyspark.sql import functions as F

    theirs = ours.withColumn("record", F.when(F.col("record_id").isin(17, 230), F.concat("record", F.lit("!"))).otherwise(F.col("record"))).where("record_id is null or record_id <> 44")
    bad = {r["record_id"]: r for r in merkle.fixity_audit(ours, theirs).collect()}
    assert set(bad) == {17, 230, 44} and bad[44]["theirs"] is None
    record = ours.where("record_id = 17").first()["record"]
    assert bad[17]["ours"] == hashlib.sha256(record.encode()).hexdigest()
    assert merkle.archive(pages.where("false")).count() == 0
    same = spark.createDataFrame([(1, "u", "p")] * 500 + [(2, "v", "q")], "page_id long, url string, html string")
    laid = merkle.archive(same, file_records=50).collect()
    per = [sum(r["file"] == f for r in laid) for f in {r["file"] for r in laid}]
    assert len(laid) == 501 and max(per) <= 250
    assert "\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in record and record.startswith("WARC/1.1\r\n") and record.endswith("\r\n\r\n")


@pytest.fixture(scope="module")
def crf():
    return crf_html.fit_chain(crf_html.grammar_pages(250), epochs=5)


def test_main_text(spark, crf):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><div class="cookie-notice">We use cookies to serve you.</div>
      <nav><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav><article><h1>A title &amp; more</h1><p>First&nbsp;paragraph with
      <b>bold</b> words, long enough to be one. It has two sentences.<p>Second one &#233;t&eacute;, also of some length, as is usual here.</p>
      <div class="ad">Buy this now and save.</div><p>Third one closes the article with some more words.</article>
      <form><label>Mail</label><button>Sign up</button></form><section class="comments"><p>I liked it. Very much so.</p></section><footer>&copy; us</footer>"""
    want = "A title & more\nFirst paragraph with bold words, long enough to be one. It has two sentences.\nSecond one été, also of some length, as is usual here.\nThird one closes the article with some more words."
    data = [(1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<script>x"), (3, "w", "<script>x")]
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in crf_html.extract(spark.createDataFrame(data, "page_id long, url string, html string"), crf).collect()))
    assert got == [(0, "", 0), (1, want, len(want)), (2, "", 0), (3, "", 0), (3, "", 0)]


def test_crf_on_unseen_layouts(crf):
    wrong = total = 0
    for feats, labels in crf_html.grammar_pages(80, seed=91):
        ids = [[crf.vocabulary[f] for f in fs if f in crf.vocabulary] for fs in feats]
        wrong += sum(a != b for a, b in zip(crf_html.viterbi(crf_html._scores(crf, ids).tolist(), crf.moves.tolist()), labels))
        total += len(labels)
    assert wrong <= 0.02 * total


def test_viterbi_finds_the_best_path():
    from itertools import product

    rng = random.Random(1)
    for _ in range(50):
        scores = [[rng.uniform(-2, 2), rng.uniform(-2, 2)] for _ in range(6)]
        moves = [[rng.uniform(-1, 1) for _ in "01"] for _ in "01"]
        best = max(product((0, 1), repeat=6), key=lambda p: sum(s[y] for s, y in zip(scores, p)) + sum(moves[a][b] for a, b in zip(p, p[1:])))
        assert crf_html.viterbi(scores, moves) == list(best)


def test_archive_layout_depends_on_content_alone(spark):
    rows = [(1, "u", "same")] * 170 + [(k, f"u{k}", f"page {k % 7}") for k in range(80)] + [(None, None, None)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    laid = lambda df: sorted(tuple(r) for r in merkle.leaves(merkle.archive(df, file_records=50)).select("file", "place", "offset", "length", F.coalesce("record_id", F.lit(-1)), "digest").collect())
    first = laid(pages)
    assert len(first) == 253 and len({r[0] for r in first if r[4] == 1}) > 1
    assert first == laid(pages.orderBy(F.rand(3)).repartition(7)) == laid(pages.coalesce(1))


def test_a_refit_sees_rows_of_one_id_in_one_order(spark):
    docs = spark.createDataFrame([(k // 3, f"word{k % 11} bad{k % 5} more{k}") for k in range(240)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, toxic int")
    a, b = (ftrl.fit(d, labels, "toxic", F.lit(True)) for d in (docs, docs.orderBy(F.desc("text")).repartition(5)))
    order = a.buckets.argsort(), b.buckets.argsort()
    assert (a.buckets[order[0]] == b.buckets[order[1]]).all() and (a.weights[order[0]] == b.weights[order[1]]).all() and a.bias == b.bias
