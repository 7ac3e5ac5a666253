"""Inputs that earlier versions got wrong, and production settings against brute force."""

import itertools
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from quarrymill.llm import crf_html, ecoc_lang, fuzzy_lines
from quarrymill.llm.fuzzy_lines import dedup_lines
from quarrymill.llm.minhash_join import near_duplicates
from quarrymill.llm.recompress import substring_dedup
from quarrymill.llm.template_decontam import EDGE, UNITS, decontaminate
from quarrymill.session import Scratch

SF = "/root/testdata/sf0.001"


def texts_of(page):
    return [b.text for b in crf_html.leaf_blocks(page)]


def test_quotes_in_attributes():
    assert texts_of("<p data-a=it's>Hello to all of you. It's fine here.</p><p>Second it is.</p>") == ["Hello to all of you. It's fine here.", "Second it is."]
    assert texts_of('<p title="a>Hello</p>') == ["Hello"]
    assert texts_of('<a href="x>y">link</a> t &amp; u<script>var a = "</p>"</script> v') == ["link t & u v"]
    assert texts_of("<p>if a < b then") == ["if a < b then"] and texts_of('<p>end<p class="x') == ["end"]


def test_deep_nesting_is_near_linear():
    took = []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        blocks = crf_html.leaf_blocks("<div>x " * n) + crf_html.leaf_blocks("<b>x <p>y" * n)
        crf_html.features(blocks)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * max(took[0], 0.05)


def test_cues_count_wherever_they_stand():
    early, late = ("Our privacy terms. " + "word " * 300, "word " * 300 + "Our privacy terms.")
    cues = [[f for f in fs if f.startswith("cue:")] for fs in crf_html.features([b for t in (early, late) for b in crf_html.leaf_blocks(f"<p>{t}</p>")])]
    assert cues[0] == cues[1] != []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_main_text_of_marked_pages(spark):
    """Fitted to a sample that leaves most pages out, blocks of pages whose markup tells their labels are labelled alike."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = crf_html.fit(pages, sample_pages=40, made_pages=200)
    wrong = total = 0
    for r in pages.collect():
        blocks = crf_html.leaf_blocks(r["html"] or "")
        labels = crf_html.marked_labels(blocks) if blocks else None
        if labels:
            text = crf_html.main_text(r["html"], model, model.moves.tolist())
            got = set(text.split("\n"))
            total += len(labels)
            wrong += sum((b.text in got) != bool(y) for b, y in zip(blocks, labels))
    assert total and wrong <= 0.03 * total


def test_letters_are_letters(spark):
    data = [(i, "der und ein", "bb") for i in range(30)] + [(i + 100, "the and thing", "aa") for i in range(30)] + [(500, "½ ² ①", None), (501, "é", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in ecoc_lang.language_id(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert got[500] == "und" and got[501] != "und"


def test_no_language_is_left_out(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(4)] for k in range(230)}
    data = [(i, " ".join(rng.choices(words[f"l{i % 230}"], k=12)), f"l{i % 230}") for i in range(2300)]
    got = ecoc_lang.language_id(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == f"l{r['doc_id'] % 230}" for r in held) >= 0.95 * len(held)


def test_every_ngram_counts_once():
    s = ecoc_lang.Settings()
    data = " " + "ab " * 80_000
    n = len(data.strip()) + 2
    assert [sum(len(b) for b in part) for part in [list(ecoc_lang.buckets(data, s))]] == [3 * n - 1 - 2 - 3]


def reworded(text, rng):
    """A benchmark text with other numbers and names, alike wherever they are alike; names in any letter case."""
    to = {}

    def word(t):
        core = t.strip(EDGE)
        if re.fullmatch(r"\d+", core):
            new = to.setdefault(core, str(rng.randint(2, 99)))
        elif core[:1].isupper():
            new = to.setdefault(core, "".join(rng.choice("abcdefghij") for _ in range(6)))
            new = new if rng.random() < 0.5 or to.get(core) != new else new
        else:
            return t
        return t.replace(core, new)

    return " ".join(map(word, text.split()))


QUESTIONS = [
    "Tom has 3 cats and 2 small dogs. Anna has 5 dogs that she walks each day. Tom buys 2 more cats at the market. How many cats does Tom have now?",
    "Before the game Maria had 12 points and Peter had 7 points on the board. After it Maria had 20 points. By how many points did Maria lead Peter?",
]


def test_reworded_questions_are_found(spark):
    rng = random.Random(4)
    items = list(enumerate(QUESTIONS))
    if os.path.isdir(SF):
        items += [(100 + r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, f"some words before it. {reworded(t, rng)} and some after it") for i, t in items], "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate(docs, bench).collect()}
    assert got[0] == [0] and got[1] == [1]
    assert sum(i in got[i] for i, _ in items) >= 0.9 * len(items)


def brute_shares(docs, items, n=5, plain=3):
    """Shares of items' windows that documents have, for texts without adjacent names and sentences that begin with small letters."""
    number = lambda w: re.fullmatch(r"\d+", w)

    def slots(words, names):
        kinds = []
        for k, w in enumerate(words):
            bare = w.strip(EDGE)
            kinds.append("n" if number(bare) else "u" if bare.lower() in UNITS and k and kinds[-1] == "n" else "x" if names and bare[:1].isupper() else "")
        return kinds

    out = {}
    for (i, d), (j, t) in itertools.product(docs, items):
        dw, iw = d.split(), t.split()
        dk, ik = slots(dw, False), slots(iw, True)
        low = lambda w: w.strip(EDGE).lower()
        windows = {tuple(low(w) for w in iw[a : a + n]) for a in range(len(iw) - n + 1)}
        groups = {}
        for a, b in itertools.product(range(len(iw) - n + 1), range(len(dw) - n + 1)):
            free = sum(not k for k in ik[a : a + n]) >= plain
            same = all((ik[a + k] == "x" and free) or (free and ik[a + k] in ("n", "u") and dk[b + k] == ik[a + k]) or ((not free or not ik[a + k]) and low(iw[a + k]) == low(dw[b + k])) for k in range(n))
            if same:
                seen, means = groups.setdefault(b - a, (set(), {}))
                seen.add(tuple(low(w) for w in iw[a : a + n]))
                for k in range(n):
                    if free and ik[a + k]:
                        means.setdefault(low(iw[a + k]), set()).add(low(dw[b + k]))
        good = set().union(*(seen for seen, means in groups.values() if not means or np.mean([len(v) > 1 for v in means.values()]) <= 0.1), set())
        if windows and len(good) >= 0.5 * len(windows) - 1e-9:
            out[i, j] = len(good) / len(windows)
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["red", "blue", "house", "tree", "walks", "buys", "sells", "near", "under", "with", "and", "then", "after", "apples", "to"]

    def sentence(n):
        out = []
        for k in range(n):
            name = rng.random() < 0.15 and k and not out[-1][0].isupper()
            out.append(rng.choice(["Tom", "Anna", "Bob"]) if name else str(rng.randint(2, 40)) if rng.random() < 0.15 else rng.choice(vocabulary))
        return out

    items = [(j, " ".join(["so", *sentence(24)])) for j in range(12)]
    docs = []
    for i in range(60):
        words = items[rng.randrange(12)][1].split()
        a, b = sorted(rng.sample(range(len(words)), 2))
        part = words[a : b + 1] if i % 3 else words
        part = [rng.choice(["Eva", "jim", str(rng.randint(2, 40))]) if i % 4 == 1 and (w[0].isupper() or w.isdigit()) else w for w in part]
        docs.append((i, " ".join(["it", *sentence(5), "of", *part, "of", *sentence(5)]).replace("\n", " ")))
    got = {}
    for r in decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect():
        for j in r["item_ids"]:
            got[r["doc_id"], j] = r["share"]
    want = brute_shares(docs, items)
    assert set(got) == set(want)
    alone = [k for k in want if sum(i == k[0] for i, _ in want) == 1]
    assert alone and all(abs(got[k] - want[k]) < 1e-9 for k in alone)


def test_recall_of_near_copies_with_the_settings_of_production(spark):
    """Pairs of texts, and of lines, a little above 80 % alike; all but very few are linked."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(7))
    texts, lines = [], []
    for k in range(250):
        a = [word() for _ in range(203)]
        b = list(a)
        for at in rng.sample(range(8, 195, 8), 5):
            b[at] = word()
        texts += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        x = [word() for _ in range(24)]
        y = list(x)
        y[11] = word()
        lines += [(2 * k, " ".join(x)), (2 * k + 1, " ".join(y))]
    near = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert sum(near[2 * k + 1] == 2 * k for k in range(250)) == 250
    gone = {r["doc_id"]: r["n_removed"] for r in dedup_lines(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert sum(gone[2 * k + 1] for k in range(250)) >= 248 and not any(gone[2 * k] for k in range(250))


def test_line_dedup_keeps_a_line_of_each_kind_where_an_id_has_two_texts(spark):
    x, y = "the first of two long lines, which several of the documents have in them", "another line that is nothing like the one before, of numbers 123 and 456 and 789"
    rows = [(0, y), (1, x), (1, y), (2, x), (3, f"{y}\n{x}")]
    for k in (1, 3, 5):
        got = sorted(map(tuple, dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(k)).collect()))
        texts = [t for r in got for t in r[1].split("\n") if t]
        assert sorted(texts) == sorted([x, y]) and got[0] == (0, y, 1, 0) and len(got) == 5


def test_custom_elements_and_unclosed_ones_keep_the_page():
    for tag in ("svg-icon", "title-card", "template-x", "style-guide", "script-x", "iframe-y", "noscript-z", "textarea-q"):
        assert " ".join(texts_of(f'<p>Start here.</p><{tag} name="x"></{tag}><p>After one.</p>')) == "Start here. After one."
    for tag in ("noscript", "svg", "template"):
        assert texts_of(f"<p>a</p><{tag} x='1'><p>b</p>") == ["a", "b"] and texts_of(f"<p>a</p><{tag}><b>gone</b></{tag} ><p>b</p><{tag}><p>c") == ["a", "b", "c"]
    assert texts_of("<p>a<svg x='1'/>b</p>c") == ["ab", "c"] and texts_of("<p>a</p><script>var b;<p>c") == ["a"] and texts_of("<TITLE>t</title><p>a") == ["a"]


def test_tags_that_nothing_closes_take_linear_time():
    for piece in ("<a ", '<p x="', "<b ='", "<noscript>", "<svg ", "</", "<!", '<a x=\'"', '="'):
        began = time.perf_counter()
        crf_html.leaf_blocks(piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - began < 10, piece


def test_lines_that_meet_by_chance_go_no_further(spark, monkeypatch):
    """Members of a list go on if another may be similar, in whatever pieces the rows come and however long lists are."""
    rng = np.random.default_rng(3)
    token = np.sort(rng.integers(0, 400, 3_000))
    token[1_000:1_400] = token[1_000]
    token.sort()
    s1, s2 = (rng.integers(-(2**63), 2**63 - 1, 3_000) for _ in "ab")
    copies = rng.integers(0, 3_000, 900)
    s1[copies], s2[copies] = s1[copies - 1] ^ 5, s2[copies - 1] ^ 8
    node, most = np.arange(3_000), fuzzy_lines.most_apart(fuzzy_lines.LINES)
    monkeypatch.setattr(fuzzy_lines, "SKETCHED_LIST", 100)
    apart = lambda i, j: (int(s1[i] ^ s1[j]) | int(s2[i] ^ s2[j])) & (2**64 - 1)
    near = {i for _, g in itertools.groupby(node, key=lambda i: token[i]) for g in [list(g)] for i in g if len(g) > 100 or any(i != j and apart(i, j).bit_count() <= most for j in g)}
    rows = pa.table({"token": token, "node": node, "s1": s1, "s2": s2})
    shared = {i for i in node if i and token[i] == token[i - 1] or i < 2_999 and token[i] == token[i + 1]}
    for size in (1, 7, 150, 3_000):
        batches = lambda: iter(rows.to_batches(max_chunksize=size))  # noqa: B023, E731
        assert [x for b in fuzzy_lines._similar(fuzzy_lines.LINES)(batches()) for x in b.column("node").to_pylist()] == sorted(near)
        assert [x for b in fuzzy_lines._meeting(batches()) for x in b.column("node").to_pylist()] == sorted(shared)
    assert 400 < len(near) < len(shared)

    rng = random.Random(5)
    words = ["".join(rng.choice("aeiou" if k % 2 else "bdklmnprst") for k in range(6)) for _ in range(60)]
    lines = [(i, " ".join(rng.choices(words, k=12))) for i in range(3_000)]
    scratch = Scratch(spark)
    gone = fuzzy_lines.repeated_lines(spark.createDataFrame(lines + [(3_000, lines[7][1] + "s")], "doc_id long, text string"), scratch=scratch).collect()
    assert [r["doc_id"]["doc_id"] for r in gone] == [3_000]
    assert spark.read.parquet(f"{scratch.root}/similar").select("node").distinct().count() < 300


def test_lists_of_the_same_lines_are_one(spark, monkeypatch):
    """Lines that meet in many bands are looked at once for all of them, and a long list stays one list, in whatever pieces it comes."""
    monkeypatch.setattr(fuzzy_lines, "SKETCHED_LIST", 20)
    rng = np.random.default_rng(4)
    sketches = rng.integers(-(2**63), 2**63 - 1, (200, 2))
    sketches[:40] = 5
    pairs = [(token, node) for token in range(16) for node in (3, 9)] + [(16, 3), (16, 9), (16, 11)]
    # The first long list ends in the piece in which the second begins.
    long = [(17, node) for node in range(100, 145)] + [(18, node) for node in range(150, 199)]
    token, node = (np.array(x) for x in zip(*pairs, *long))
    rows = pa.table({"token": token, "node": node, "s1": sketches[node, 0], "s2": sketches[node, 1]})
    for size in (1, 40, 41, 79, 200):
        lists = {}
        for b in fuzzy_lines._similar(fuzzy_lines.LINES)(iter(rows.to_batches(max_chunksize=size))):
            for t, n in zip(*(b.column(c).to_pylist() for c in ("token", "node"))):
                lists.setdefault(t, set()).add(n)
        assert sorted(map(sorted, lists.values())) == [[3, 9], [3, 9, 11], list(range(100, 145)), list(range(150, 199))], size

    line = "a line that is long enough to be compared with its copy in other documents"
    scratch = Scratch(spark)
    got = dedup_lines(spark.createDataFrame([(1, line), (2, line + "s"), (3, "another")], "doc_id long, text string"), scratch=scratch)
    assert sorted((r["doc_id"], r["n_removed"]) for r in got.collect()) == [(1, 0), (2, 1), (3, 0)]
    # What only told which lines go is deleted before documents are read again.
    assert not {"signed", "classes", "texts"} & set(os.listdir(scratch.root.removeprefix("file:")))


def test_bands_meet_in_buckets_without_a_sort_of_all(monkeypatch):
    """Buckets give the rows that share a token, each once, in whatever pieces they come and however far a list outgrows its bucket."""
    rng = np.random.default_rng(9)
    s = fuzzy_lines.Settings(shingle=5, bands=3, rows=2)
    hashes = rng.integers(0, 2_000, (900, 3)).astype(np.uint32)
    hashes[rng.permutation(900)[:500], 1] = 7
    node, by = np.arange(900) * 3, {}
    for n, row in zip(node, hashes):
        for band, h in enumerate(row):
            by.setdefault(band << 32 | int(h), set()).add(int(n))
    want = sorted((t, n) for t, ns in by.items() if len(ns) > 1 for n in ns)
    lines = pa.table({"node": node, "bands": [r.tobytes() for r in hashes]})
    for dealt, piece, rows, most in ((50, 10, 1, 20), (1_000, 900, 40, 30), (200, 100, 7, 1_000_000)):
        monkeypatch.setattr(fuzzy_lines, "DEALT_LINES", dealt)
        monkeypatch.setattr(fuzzy_lines, "BUCKET_ROWS", most)
        buckets = pa.Table.from_batches(fuzzy_lines._dealt(s, 4)(iter(lines.to_batches(max_chunksize=piece)))).sort_by("bucket")
        met = fuzzy_lines._meeting(fuzzy_lines._in_order(4)(iter(buckets.to_batches(max_chunksize=rows))))
        assert sorted((t, n) for b in met for t, n in zip(*(b.column(c).to_pylist() for c in ("token", "node")))) == want


def test_lines_of_odd_documents_are_counted_and_cut_alike(spark):
    line = "a line that is long enough to be compared with its copy in others"
    texts = [(1, f"{line}\n\n \t\nééé 日本"), (1, f"{line}\n\n \t\nééé 日本"), (2, f"\n{line} \r\n"), (3, None), (4, ""), (None, line), (5, "\n")]
    got = dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(*texts[0], 4, 0), (*texts[0], 4, 0), (2, "\n", 3, 1), (3, "", 1, 0), (4, "", 1, 0), (None, line, 1, 0), (5, "\n", 2, 0)], key=str)


def test_texts_of_one_id_with_fewer_windows_than_another(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "short"), (1, f"{' '.join(f'v{i}' for i in range(40))} {passage}"), (2, f"u {passage} t"), (3, passage)]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 0), (1, 100, 0), (2, 62, 60), (3, 60, 60)]
