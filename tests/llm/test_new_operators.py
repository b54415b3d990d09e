"""Operators 11 to 13 against brute force: whole queries on a table, and fixtures of odd rows."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import anagram, periodic, piecewise
from tidemark.llm.queries import QUERIES, misspelled, repeating

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "Apple apples aple APPLE apple applé applé applé", "x"), (2, None, "x"), (2, None, "x"), (3, "", None), (None, "apple " * 400, "x"),
    (None, "apple " * 400, "y"), (4, "ab " * 300 + "end", "x"), (4, "ab " * 300 + "end", "x"), (5, "Zurück zurück zurük zurück zurück", None),
    (10, "one two three " * 5000, "x"), (7, "æ×ç÷ words\x0bb", "x"), (2**40, "same " * 30, "x"),
]


def rows_of(sf=SF):
    return duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()


def table(spark, tmp_path, rows):
    at = str(tmp_path / "sf")
    schema = "doc_id bigint, text string, source string, fingerprint string, runs string, word string, part int, lang string, n_chars bigint"
    full = [(i, t, s, "f", "r", "w", 1, "l", 3) for i, t, s in rows]
    spark.createDataFrame(full, schema).coalesce(2).write.parquet(f"{at}/documents.parquet")
    return at


# 11


def edits(rows):
    """(id, text, next text) in descending order of id; the rows have distinct ids."""
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    return [(i, t, u) for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_fingerprint(text):
    """By the definition, a byte at a time."""
    data = [b + 1 for b in text.encode()]

    def mixed(h):
        h = ((h ^ (h >> 16)) * 0x85EBCA6B) % 2**32
        h = ((h ^ (h >> 13)) * 0xC2B2AE35) % 2**32
        return h ^ (h >> 16)

    def chunks(size):
        out, now = [], []
        for i, b in enumerate(data):
            now.append(b)
            roll = mixed(sum(x * 0x01000193**k for k, x in enumerate(data[max(0, i - 6) : i + 1][::-1])) % 2**32)
            if roll % size == 0 or i == len(data) - 1:
                out.append(now)
                now = []
        return out if len(out) <= 64 else [*out[:63], [b for c in out[63:] for b in c]]

    if not data:
        return "1::"
    size = 1
    while len(data) > 48 * size:
        size *= 2
    while size > 1 and len(chunks(size)) < 16:
        size //= 2
    name = lambda c: piecewise.ALPHABET[mixed(sum(b * 0x9E3779B1**k for k, b in enumerate(c)) % 2**32) >> 26]
    return f"{size}:{''.join(map(name, chunks(size)))}:{''.join(map(name, chunks(2 * size)))}"


def test_fingerprints_follow_the_definition():
    random.seed(4)
    texts = ["", "a", "ab", "né", "same " * 60, "x" * 500, *("".join(random.choices("abcdé \n", k=random.randint(1, 900))) for _ in range(40))]
    assert [piecewise.fingerprint_of(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def slow_likeness(f, g):
    def alike(a, b):
        short = min(len(a), len(b))
        run = min(7, (short + 1) // 2)
        common = short and {a[i : i + run] for i in range(len(a) - run + 1)} & {b[i : i + run] for i in range(len(b) - run + 1)}
        return 1 - distance(a, b) / max(len(a), len(b)) if common else 0.0

    if f == g:
        return 1.0
    (p, *a), (q, *b) = f.split(":"), g.split(":")
    return max((alike(x, y) for j, x in enumerate(a) for k, y in enumerate(b) if int(p) << j == int(q) << k), default=0.0)


@pytest.mark.parametrize("parts", [1, 5])
def test_every_row_beside_its_next(spark, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = QUERIES["op11_fingerprints"](spark, SF).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r.doc_id: r for r in rows}
    want = edits(rows_of())
    assert len(rows) == len(want) == len(got)
    for i, t, u in want:
        k = len(t) // 3
        e, r = t[: len(t) - k] + u[:k], got[i]
        f, g = piecewise.fingerprint_of(t), piecewise.fingerprint_of(e)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), sha(e), f, g)
        assert r.near_edited == pytest.approx(slow_likeness(f, g)) and r.near_next == pytest.approx(slow_likeness(f, piecewise.fingerprint_of(u)))
    near = sorted(r.near_edited for r in rows)
    assert near[len(near) // 20] > 0.4 and sum(r.near_next > 0.3 for r in rows) < len(rows) / 20


def test_fingerprints_of_odd_rows(spark, tmp_path):
    got = QUERIES["op11_fingerprints"](spark, table(spark, tmp_path, ODD)).collect()
    order = sorted(ODD, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).digest()))
    want = Counter()
    for (i, t, _), (_, u, _) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        want[i, len(t), sha(t[: len(t) - len(t) // 3] + u[: len(t) // 3])] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    one = QUERIES["op11_fingerprints"](spark, table(spark, tmp_path / "one", ODD[:1])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert QUERIES["op11_fingerprints"](spark, table(spark, tmp_path / "none", [])).count() == 0


def test_an_executor_range_may_hold_one_row(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * 9) for i in range(3)], "doc_id int, text string")
    got = {r.doc_id: r for r in piecewise.beside_next(docs).collect()}
    assert len(got) == 3 and got[0].next_fingerprint == got[2].fingerprint and got[2].next_fingerprint == got[1].fingerprint


# 12


def slow_variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{i}:{run}".encode()) if i is not None else 1
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: set() for w in n}
    holes = {}
    for w in n:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
            if (less := w[:i] + w[i + 1 :]) in n:
                near[w].add(less)
                near[less].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def plain(rows):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows]


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_every_word_finds_its_variants(spark, sf):
    got, want = plain(QUERIES["op12_spelling_variants"](spark, sf).collect()), slow_variants(rows_of(sf))
    assert len(got) == len(want) and set(got) == want
    assert any(r[5] for r in want) and any(r[2] != (r[1] or r[0]) for r in want)


def test_words_of_odd_rows(spark, tmp_path):
    got = plain(QUERIES["op12_spelling_variants"](spark, table(spark, tmp_path, ODD)).collect())
    want = slow_variants([r[:2] for r in ODD])
    assert len(got) == len(want) and set(got) == want and "apple" in {r[0] for r in want}
    assert QUERIES["op12_spelling_variants"](spark, table(spark, tmp_path / "none", [])).count() == 0


def test_words_of_few_letters_in_any_order(spark):
    random.seed(8)
    words = {"".join(random.choices("aabé", k=random.randint(1, 7))): random.randint(3, 60) for _ in range(400)}
    got = anagram.group_variants(spark.createDataFrame(list(words.items()), "word string, n int"))
    near = {w: {x for x in words if abs(len(x) - len(w)) < 2 and distance(w, x) == 1} for w in words}
    assert {(r.word, r.n_near) for r in got.collect()} == {(w, len(near[w])) for w in words}


def test_roots_at_the_end_of_a_long_chain(spark):
    chain = [("a" * k + "b" * (30 - k), 2 ** (k + 2)) for k in range(31)]
    got = anagram.group_variants(spark.createDataFrame(chain, "word string, n bigint")).collect()
    assert len(got) == 31 and {r.root for r in got} == {"a" * 30}


def test_words_without_letters_and_letters_without_a_place(spark):
    got = anagram.group_variants(spark.createDataFrame([("", 4), (None, 5), ("a", 3)], "word string, n int")).collect()
    assert plain(got) == [("a", None, "a", 3, 0, None)]
    with pytest.raises(Exception, match="alphabet"):
        anagram.group_variants(spark.createDataFrame([("жжжжж", 4)], "word string, n int")).collect()


def test_values_tell_every_exchange_apart():
    fifth = [k**5 for k in range(1, 91)]
    sums = [a + b for i, a in enumerate(fifth) for b in fifth[i:]]
    assert len(set(sums)) == len(sums)


def test_keys_are_those_of_anagrams(spark):
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    df = spark.createDataFrame([(c + "ab",) for c in letters] + [("ba" + c,) for c in letters], "word string")
    rows = df.select("word", anagram.key_of(F.col("word")).alias("k")).collect()
    place = {c: i for i, c in enumerate(letters, 1)}
    assert all(r.k == sum(place[c] ** 5 for c in r.word) for r in rows)


def test_misspelled_words_lose_one_letter(spark):
    docs = spark.createDataFrame([(i, "Banana Äpfel") for i in range(2000)], "doc_id int, text string")
    got = Counter(r.word for r in misspelled(docs).collect())
    want = Counter()
    for i in range(2000):
        for run in ("banana", "Äpfel"):
            h = crc32(f"{i}:{run}".encode())
            want[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    assert got == want and len(want) > 5


# 13


def slow_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(24, 3 * q) and not any(all(words[k] == words[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def slow_document(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = slow_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    return (i, len(runs), *best, milli, sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_runs_of_few_words_in_any_order():
    random.seed(3)
    found = 0
    for _ in range(400):
        k, words = random.choice([1, 2, 2, 3, 5, 300]), []
        for _ in range(random.randint(1, 5)):
            block = [random.randrange(k) for _ in range(random.randint(1, 60))]
            words += (block * 8)[: random.randint(1, 5 * len(block) + 20)]
        want = slow_runs(words)
        found += len(want)
        assert periodic.find_runs(words) == want
    assert found > 200


@pytest.mark.parametrize("q", [1, 7, 8, 9, 15, 16, 17, 31, 32, 33, 100, 333])
@pytest.mark.parametrize("before", [0, 5, 63])
def test_the_shortest_run_of_a_period(q, before):
    least = max(24, 3 * q)
    run = [k % q for k in range(least)]
    head, tail = [f"h{k}" for k in range(before)], ["t1", "t2"]
    assert periodic.find_runs(head + run + tail) == [(before, least, q)]
    assert periodic.find_runs(head + run[:-1] + tail) == []


def test_long_repetitions_take_time_in_proportion():
    assert periodic.find_runs(["a"] * 60_000) == [(0, 60_000, 1)]
    runs = periodic.find_runs((["a"] * 100 + ["b"]) * 600)
    assert (0, 60_600, 101) in runs and len(runs) == 601


def test_every_document_gives_its_runs(spark):
    got = {tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    want = {slow_document(i, t) for i, t in rows_of()}
    assert got == want and sum(r[1] for r in want) > 10


def test_runs_of_odd_rows(spark, tmp_path):
    rows = [r for r in ODD if r[0] != 10] + [(k, "w1 w2 w3 w4 w5 " * k, "x") for k in range(11, 60)]
    got = Counter(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, table(spark, tmp_path, rows)).collect())
    assert got == Counter(slow_document(i, t) for i, t, _ in rows)
    assert QUERIES["op13_periodic_runs"](spark, table(spark, tmp_path / "none", [])).count() == 0


def test_a_clashing_column_is_replaced(spark):
    docs = spark.createDataFrame([(1, "a " * 30, "old")], "doc_id int, text string, runs string")
    row = periodic.periodic_runs(docs).collect()[0]
    assert row.collapsed == "a" and [tuple(r) for r in row.runs] == [(0, 30, 1)]
    assert piecewise.fingerprint(docs.withColumn("fingerprint", F.lit(1))).collect()[0].fingerprint == piecewise.fingerprint_of("a " * 30)
    assert repeating(docs).columns == ["doc_id", "text"]
