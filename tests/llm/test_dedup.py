import hashlib
import random
import re
from collections import OrderedDict

from quarrymill.llm import recompress
from quarrymill.llm.exact_names import exact_dedup
from quarrymill.llm.fuzzy_lines import Settings as LineSettings
from quarrymill.llm.fuzzy_lines import dedup_lines
from quarrymill.llm.minhash_join import near_duplicates
from quarrymill.llm.recompress import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_exact(docs, rows):
    want = brute_exact(rows)
    assert {r[0]: tuple(r)[1:] for r in exact_dedup(docs).collect()} == want
    # Small blocks and crowded buckets take the same texts through pairing and through places in buckets.
    assert {r[0]: tuple(r)[1:] for r in exact_dedup(docs, block_chars=16, name_bits=3).collect()} == want


def test_exact_odd(odd, empty):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(odd).collect()), key=str)
    assert len(got) == 6 and sum(g[3] == 4 for g in got) == 4
    assert exact_dedup(empty).count() == 0


def brute_near(rows, n=4):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    groups, ids = Sets(), sorted(sets)
    for a in ids:
        groups.find(a)
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    groups.join(a, b)
    return {i: (len(sets[i]), groups.find(i), groups.find(i) == i) for i in ids}


def test_near(docs, rows):
    assert {r[0]: tuple(r)[1:] for r in near_duplicates(docs).collect()} == brute_near(rows)


def test_near_odd(odd, empty):
    got = [tuple(r) for r in near_duplicates(odd).collect()]
    assert len(got) == 6
    assert sorted(r[2] for r in got if r[0] in (1, 2)) == [1, 1, 1]
    assert all(r[2] is None and r[3] for r in got if r[0] is None)
    assert near_duplicates(empty).count() == 0


def test_near_copies_of_one_text(spark):
    """Many near copies, some of them further apart than a link allows, in chains and stars."""
    import random

    rng = random.Random(8)
    base, data = [f"w{k}" for k in range(120)], []
    for i in range(150):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            text[rng.randrange(120)] = f"e{i}x{rng.randrange(9)}"
        if i % 5 == 0:
            text = text[: rng.randint(90, 120)]
        data.append((i, " ".join(text)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {r[0]: tuple(r)[1:] for r in near_duplicates(df).collect()} == brute_near(data)


def brute_substrings(rows, size=20):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            if key in seen:
                gone[p : p + size] = [True] * size
            seen.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def test_substrings(docs, rows):
    want = brute_substrings(rows)
    for rounds in (1, 2):
        assert {r[0]: tuple(r)[1:] for r in substring_dedup(docs, rounds=rounds).collect()} == want


def test_substrings_of_few_words(spark):
    """Runs and periods, where windows have no anchors or many equal ones."""
    import random

    rng = random.Random(2)
    data = [(i, " ".join(rng.choice(["a", "a a a a a a a", "b", "a b", "c"]) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    got = {r[0]: tuple(r)[1:] for r in substring_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == brute_substrings(data)


def test_words_are_hashed_as_they_come(monkeypatch):
    """Looking up the many rare words of a text took longer than the hashes of all."""
    words, hashed, digest = [f"w{i % 900}".encode() for i in range(2_000)], [], recompress.word_hash
    monkeypatch.setattr(recompress, "word_hash", lambda w: hashed.append(w) or digest(w))
    d = recompress._Doc(b" ".join(words).decode(), 20, recompress._Powers())
    assert hashed == words and d.h.tolist() == list(map(digest, words))
    assert d.fresh.tolist() == [True] * 900 + [False] * 1_081


def test_substrings_odd(odd, empty):
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup(odd).collect())
    n = 26
    assert got == [(0, 0, 0), (0, n, 0), (1, n, 0), (1, n, 0), (2, n, n), (3, 0, 0)]
    assert substring_dedup(empty).count() == 0


def brute_lines(rows, size=12):
    space = " \t\n\x0b\x0c\r"
    first = OrderedDict()
    for i, t in sorted(rows, key=lambda r: r[0]):
        for at, x in enumerate((t or "").split("\n")):
            if x.strip(space):
                first.setdefault(x.strip(space), (i, at))
    sets = {x: {x[k : k + size] for k in range(max(1, len(x) - size + 1))} for x in first}
    groups = Sets()
    for a in first:
        for b in first:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                groups.join(first[a], first[b])
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for at, x in enumerate(lines) if not x.strip(space) or groups.find(first[x.strip(space)]) == (i, at)]
        out[i] = ("\n".join(keep), len(lines), len(lines) - len(keep))
    return out


def test_lines(docs, rows):
    # More bands than in production, so that a fixture without chance has no misses.
    assert {r[0]: tuple(r)[1:] for r in dedup_lines(docs, LineSettings(bands=20, rows=3)).collect()} == brute_lines(rows)


def test_lines_odd(odd, empty):
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in dedup_lines(odd).collect())
    assert got == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 1), (3, 0)]
    assert dedup_lines(empty).count() == 0


def test_lines_of_ordinary_length(spark):
    """One-letter, one-number and one-word variants in mid-line, with the settings of production."""
    rng, data, pairs = random.Random(21), [], []
    for length in range(30, 111, 2):
        for kind in ("letter", "number", "word"):
            half = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(length)) for _ in "ab"]
            spaced = ["".join(" " if k % 6 == 5 else c for k, c in enumerate(x))[: length // 2 - 2].strip() for x in half]
            old, new = {"letter": ("mole", "mule"), "number": ("1994", "1934"), "word": ("moor", "hill")}[kind]
            pairs.append(tuple(f"{spaced[0]} {x} {spaced[1]}" for x in (old, new)))
    for i, (a, b) in enumerate(pairs):
        data += [(2 * i, a), (2 * i + 1, b)]
    got = {r["doc_id"]: r["n_removed"] for r in dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: gone for i, (_, _, gone) in brute_lines(data, 5).items()}
    linked = [len(a) for i, (a, b) in enumerate(pairs) if got[2 * i + 1]]
    assert all(got[2 * i + 1] for i, (a, _) in enumerate(pairs) if i % 3 < 2 and len(a) >= 49) and len(linked) >= 60
    # A shingle of 12 characters keeps all of them apart.
    assert not any(gone for _, _, gone in brute_lines(data, 12).values())
