"""Fill-in-middle, SimHash and spelling groups against plain versions, on edge cases and with small blocks."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

from tessera.llm import op11_fill_in_middle as op11, op12_simhash as op12, op13_spelling as op13

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, source string, n int, fp string, form string, output string, `a.b` int, word string, component_id int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "x", "y", "z", 2, "w", 3) for i, t in rows], SCHEMA).repartition(3)


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- fill in the middle


def plain_middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def middle_rows():
    r = random.Random(3)
    letters = "abc \n\r\té́ß中\U0001f926‍\x00<PSM>"
    rows = [(k, "".join(r.choice(letters) for _ in range(r.randrange(0, 700)))) for k in range(150)]
    rows += [(None, "a text without id"), (None, None), (1, None), (2, ""), (3, "x"), (4, "<P> marked"), (5, "ends <"), (5, "ends <"), (6, "long ü " * 9000)]
    return rows


@pytest.mark.parametrize("run", [op11.RUN, 3])
def test_middle_equals_plain(spark, run):
    rows = middle_rows()
    out = op11.transform(table(spark, rows), run=run).withColumn("back", op11.restored())
    got = sorted(((r.doc_id, r.back, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()), key=repr)
    assert got == sorted(((i, t or "", *plain_middle(i, t)) for i, t in rows), key=repr)
    assert {x[3] for x in got} == {"plain", "psm", "spm"} and out.columns[:3] == ["doc_id", "text", "source"] and out.first()["a.b"] == 2


def test_code_points_by_rank():
    splitter = op11.Splitter(4)
    for text in ("", "a", "abcd", "abcde", "é\n\r\n中" * 300):
        points = op11.CodePoints(text, splitter)
        assert points.n == len(text) and [points.cut(k) for k in range(len(text) + 1)] == list(range(len(text) + 1))


# --- SimHash


def plain_print(text, k=4):
    words = WORD.findall(fold(text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, bits):
    """doc_id's component by rows (doc_id, fingerprint)."""
    distinct = sorted({f for _, f in prints})
    label = {f: f for f in distinct}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    first = {}
    for i, f in prints:
        if i is not None:
            first[root(f)] = min(i, first.get(root(f), i))
    return sorted(((i, f, first.get(root(f))) for i, f in prints), key=repr)


def near_rows():
    r = random.Random(8)
    words = [f"w{k}É" if k % 5 == 0 else f"W{k}" for k in range(400)]
    rows = []
    for k in range(160):
        text = [r.choice(words) for _ in range(r.randrange(40, 300))]
        if k % 3 and rows:  # chains of small changes
            text = rows[-1][1].split(" ")
            for _ in range(r.randrange(0, 3)):
                text[r.randrange(len(text))] = r.choice(words)
        rows.append((k, " ".join(text)))
    rows += [(None, rows[4][1]), (None, "two words"), (200, "one"), (201, ""), (202, None), (203, " \n"), (204, rows[0][1]), (204, rows[0][1].replace(" ", "\t\n"))]
    return rows


def test_fingerprints_equal_plain():
    for _, text in near_rows():
        assert op12.fingerprint(text or "") == plain_print(text) == op12.fingerprint(text or "", size=25)


@pytest.mark.parametrize("block", [op12.BLOCK, 2])
def test_components_equal_plain(spark, block):
    rows = near_rows()
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in op12.near_duplicates(table(spark, rows), block=block).collect()), key=repr)
    want = plain_components([(i, plain_print(t)) for i, t in rows], 4)
    assert got == want and len({c for _, _, c in want}) < len(rows) - 20


@pytest.mark.parametrize("block", [1024, 5])
def test_links_of_a_dense_group(spark, block):
    """Fingerprints around a few centres, linked only through one another: no link is lost in lists that are dealt out."""
    r = random.Random(1)
    prints = set()
    for _ in range(4):
        x = r.getrandbits(64)
        for _ in range(60):
            for b in r.sample(range(64), r.randrange(0, 4)):
                x ^= 1 << b
            prints.add(x)
    signed = [x - 2**64 if x >> 63 else x for x in prints]
    links = op12.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block)
    label = {x: x for x in signed}
    label.update({r.cls: r.label for r in op12.components(links).collect()})
    groups = {}
    for x, y in label.items():
        groups.setdefault(y, set()).add(x % 2**64)
    want = {}
    for i, f, c in plain_components(list(enumerate(sorted(prints))), 4):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_every_four_positions_hold_a_set():
    from itertools import combinations

    sets = op12.triples()
    assert len(sets) == 20 and all(any(set(t) <= set(f) for t in sets) for f in combinations(range(8), 4))


# --- spelling


def plain_groups(rows, min_chars=5, min_count=3):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        out[w] = [best if best and words[best] >= 2 * n else None, n, len(close)]
    rows = []
    for w, (form, n, count) in out.items():
        end = w
        while out[end][0]:
            end = out[end][0]
        rows.append((w, form, end, n, count, words[form] if form else None))
    return sorted(rows)


def spelled_rows():
    r = random.Random(4)
    stems = ["garden", "gardens", "gardener", "Straße", "straßen", "élève", "eleve", "aaaaa", "aaaaaa", "aaaaaaa", "abababab", "hamster", "hampster"]
    rows = []
    for k in range(220):
        words = []
        for _ in range(30):
            w = r.choice(stems) if r.random() < 0.9 else "noise" + r.choice("abcdefg") * 2
            if r.random() < 0.25:
                at, letter = r.randrange(len(w)), r.choice("abeéÿx")
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + letter + w[at:], w[:at] + letter + w[at + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((k, r.choice([" ", "-", "×, ", "÷1", "Ā"]).join(words)))
    rows += [(None, "garden gardon gardon gardon"), (1, None), (2, ""), (3, "... 123 中文"), (7, "garden"), (7, "garden"), (8, "x" * 3000 + " " + "x" * 3000), (9, "x" * 3000 + " " + "x" * 2999)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_groups_equal_plain(spark, small):
    rows = spelled_rows()
    kw = {"shard_letters": 60, "pass_bytes": 4000} if small else {}
    got = sorted(tuple(r) for r in op13.group(table(spark, rows), **kw).select("word", "form", "root", "n", "n_near", "form_n").collect())
    want = plain_groups(rows)
    assert got == want and sum(w[1] is not None for w in want) > 10 and any(w[1] not in (None, w[2]) for w in want)


def test_words_in_pieces():
    for i, text in spelled_rows():
        assert op13.words_of(i, text or "", piece=7) == op13.words_of(i, text or "")


def test_trie_finds_all_neighbours():
    r = random.Random(6)
    words = sorted({"".join(r.choice("abc\xe9") for _ in range(r.randrange(1, 7))).encode("latin-1") for _ in range(400)})
    trie = op13.Trie.unpack(op13.Trie.build(words, list(range(len(words)))).pack())
    for w in words[::3] + [b"", b"zzz", b"abcab"]:
        letters = sorted(set(b"".join(words)))
        around = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + bytes([c]) + w[k + d :] for k in range(len(w) + 1) for c in letters for d in (0, 1) if k + d <= len(w)}
        assert {trie.word(k) for k in trie.near(w)} == (around & set(words)) - {w}


@pytest.mark.parametrize("op", [op11, op12, op13], ids=["op11", "op12", "op13"])
def test_empty_tables(spark, op, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert op.query(spark, str(tmp_path)).collect() == []
