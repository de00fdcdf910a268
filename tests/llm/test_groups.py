import base64
import hashlib
import itertools
import random

import regex
import xxhash
from pyspark.sql import functions as F

from scholia.llm import chat, common, line_dedup, near_duplicates, warc


def _components(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    random.seed(1)
    edges = [(random.randint(0, 80), random.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)]
    df = spark.createDataFrame([*edges, (3, 3), (None, 5)], "a long, b long")
    want = _components({x for e in edges for x in e}, edges)
    got = {r["node"]: r["component"] for r in common.connected_components(df).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: want[n] for n in linked}


def test_alignment_by_definition():
    random.seed(2)
    for _ in range(400):
        a = [random.randint(0, 30) for _ in range(random.randint(1, 40))]
        b = list(a)
        for _ in range(random.randint(0, 6)):
            i = random.randrange(len(b) + 1)
            b[i : i + random.randint(0, 1)] = [random.randint(0, 30)] * random.randint(0, 1)
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        s = row[-1] / (len(a) + len(b) - row[-1])
        assert abs(near_duplicates.aligned(a, b) - (s if s >= 0.8 else 0)) < 1e-9


def _texts(seed, n, vocabulary=400):
    random.seed(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    return [[random.choice(words) for _ in range(random.randint(60, 200))] for _ in range(n)]


def test_classes_by_brute_force(spark, documents):
    """Families of edited copies, one larger than a bucket."""
    rows, n = [], 0
    for k, base in enumerate(_texts(3, 8)):
        for _ in range(60 if k == 0 else 5):
            own = list(base)
            for _ in range(random.randint(0, 4)):
                own[random.randrange(len(own))] = random.choice(["new", "w1", "other"])
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, ""), (503, ""), (504, None), (505, None), (506, "short text"), (507, "Short, text!"), (508, "!!!"), (None, rows[0][1])]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.classes(documents(rows)).collect()}
    ids = [i for i, t in rows if i is not None and t is not None]
    text = {i: t for i, t in rows if i is not None}
    lists = dict(zip(ids, near_duplicates.shingle_lists([text[i] for i in ids]), strict=True))
    edges = [(a, b) for a, b in itertools.combinations(ids, 2) if text[a] == text[b] or near_duplicates.aligned(lists[a], lists[b]) > 0]
    assert got == _components(ids, edges)
    kept = near_duplicates.keep_one(documents(rows)).select("doc_id").collect()
    assert sorted(str(r[0]) for r in kept) == sorted([*map(str, set(got.values())), "504", "505", "None"])


def _norm(line):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip()


def _simhash(words):
    hashes = []
    for w in words:
        a = xxhash.xxh64(w.encode(), seed=42).intdigest()
        hashes.append(a)
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return row[-1]


def _share_two(x, y):
    """Whether two lines have as large blocks, and two that are equal."""

    def blocks(words):
        n, size = len(words), max(1, len(words) // 5)
        size = size >> max(0, size.bit_length() - 3) << max(0, size.bit_length() - 3)
        out = [[] for _ in range(5)]
        for i, w in enumerate(words):
            if i < 2 * size:
                out[i // size].append(w)
            elif i >= n - 2 * size:
                out[4 - (n - 1 - i) // size].append(w)
            else:
                out[2].append(w)
        return size, out

    (m, a), (n, b) = blocks(x.split(" ")), blocks(y.split(" "))
    return m == n and sum(bool(u) and u == v for u, v in zip(a, b, strict=True)) > (m < line_dedup.ALONE)


def test_recall_of_edited_lines(spark, documents):
    """Real lines and a copy of each with one to three characters changed anywhere (spaces too): of those that are still
    at the edit similarity at least 0.9 are grouped with the original, in every class of length."""
    import pyarrow.parquet as pq

    random.seed(31)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    lines = list({_norm(x): None for t in texts for x in t.split("\n") if len(_norm(x).split(" ")) >= 5})
    random.shuffle(lines)
    rows, pairs = [], []
    for k, x in enumerate(lines[:1800]):
        y = list(x)
        for _ in range(k % 3 + 1):
            i, kind = random.randrange(len(y)), random.randrange(3)
            y[i : i + 1] = {0: [random.choice("abcdefghij")], 1: [], 2: [y[i], random.choice("abcdefghij")]}[kind]
        y = _norm("".join(y))
        if y != x and k % 3 + 1 <= int(0.1 * max(len(x), len(y)) + 1e-9):
            pairs.append((len(x.split(" ")), k))
            rows += [(2 * k, x), (2 * k + 1, y)]
    gone = {r["doc_id"] for r in line_dedup.dropped(documents(rows)).collect()}
    classes = {}
    for n, k in pairs:
        got = classes.setdefault("5-10" if n <= 10 else "11-30" if n <= 30 else "31-100" if n <= 100 else "more", [0, 0])
        got[0] += 2 * k + 1 in gone or 2 * k in gone
        got[1] += 1
    print({c: (a, b, round(a / b, 4)) for c, (a, b) in classes.items()})
    assert all(a >= 0.9 * b for a, b in classes.values()) and sum(b for _, b in classes.values()) > 1000


def test_lines_by_brute_force(spark, documents):
    random.seed(4)
    bases = [" ".join(x) for x in _texts(5, 6)]
    rows = []
    for i in range(30):
        lines = []
        for _ in range(random.randint(0, 5)):
            words = random.choice(bases).split()
            for _ in range(random.choice([0, 0, 1, 1, 2])):
                words[random.randrange(len(words))] = random.choice(["zz", "w7"])
            lines.append(random.choice([" ", ""]) + " ".join(words) + random.choice(["", ".", "!"]))
        rows.append((i, "\n".join([*lines, "", "Unique line %d" % i, "Common line.", "---"])))
    rows += [(40, None), (41, ""), (None, "Common line."), (42, "Common line."), (43, "long " * 20_000), (44, "Common line."), (44, "Common line."), (45, " ".join(f"v{i % 300}" for i in range(700))), (45, " ".join(f"v{i % 300}" for i in range(700)))]
    first, where = {}, {}
    for i, t in rows:
        for j, line in enumerate((t or "").split("\n")):
            if i is not None and _norm(line):
                where[i, j] = _norm(line)
                first.setdefault(_norm(line), (i, j))
    names = list(first)
    marks = {x: _simhash(x.split(" ")) for x in names}
    edges = []
    for x, y in itertools.combinations(names, 2):
        if _share_two(x, y) and (marks[x] ^ marks[y]).bit_count() <= line_dedup.DISTANCE[(len(x.split(" ")) >= 10) + (len(x.split(" ")) >= 5 * line_dedup.ALONE)] and _levenshtein(x, y) <= int(0.1 * max(len(x), len(y)) + 1e-9):
            edges.append((first[x], first[y]))
    group = _components(first.values(), edges)
    want = [(i, None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in where or group[first[where[i, j]]] == (i, j))) for i, t in rows]
    got = line_dedup.dedup_lines(documents(rows)).select("doc_id", "text").collect()
    assert edges and sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_simhash_by_definition(spark, documents):
    """Lines about as long as a part and as two, words repeated, a row twice."""
    random.seed(14)
    rows = [(n, " ".join(random.choice(["a", "b", "c", f"x{random.randrange(50)}"]) for _ in range(n))) for n in (1, 2, 3, 126, 127, 128, 129, 253, 254, 255, 381, 1000)]
    rows.append(rows[-1])
    full = (1 << 64) - 1
    got = {(r["doc_id"], r["sim"] & full) for r in line_dedup.signed_lines(documents(rows)).collect()}
    assert got == {(i, _simhash(t.split(" "))) for i, t in rows}


def _flip(x, bits):
    for b in bits:
        x ^= 1 << b
    return x


def _blocks():
    low = F.lit(0xFFFFFFFF)
    return [b for half in (F.col("s.lo"), F.col("s.hi")) for b in (half.bitwiseAND(low), F.shiftrightunsigned(half, 32))]


def _keys(values, state):
    return F.array(*[F.struct(F.xxhash64("key", F.lit(i), v).alias("key"), F.coalesce(state, F.lit(i)).cast("long").alias("state")) for i, v in enumerate(values)])


def _by_block():
    """Buckets by each of four blocks of 32 bits."""
    return _keys(_blocks(), F.lit(None))


def _by_rest():
    """Buckets by each of four blocks of 24 bits, of the 96 bits beside the block that was taken."""
    x, y, z = [F.get(F.array(*_blocks()), F.pmod(F.col("state") + i, F.lit(4))) for i in (1, 2, 3)]
    cut = lambda v, low, size: F.shiftrightunsigned(v, low).bitwiseAND(F.lit((1 << size) - 1))
    over = lambda v, w: F.shiftleft(v, 32).bitwiseOR(w)
    return _keys([cut(x, 0, 24), over(cut(x, 24, 8), cut(y, 0, 16)), over(cut(y, 16, 16), cut(z, 0, 8)), cut(z, 8, 24)], F.col("state"))


def _within_three(s, t):
    return F.bit_count(s["lo"].bitwiseXOR(t["lo"])) + F.bit_count(s["hi"].bitwiseXOR(t["hi"])) <= 3


def _signed(spark, values):
    half = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(i, (half(v & (1 << 64) - 1), half(v >> 64))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "node long, s struct<lo: long, hi: long>")


def test_every_pair_of_a_large_bucket(spark, monkeypatch):
    """Pairs at distance 3 that share one block alone, all in one bucket: none is lost, whatever the bucket's size, and
    whether it is compared in chunks or split."""
    random.seed(15)
    values = []
    for k in range(600):
        x = random.getrandbits(128) >> 32 << 32 | 0xDEADBEEF
        values += [x, _flip(x, [random.randrange(32 * i, 32 * i + 32) for i in (1, 2, 3)])]
    want = {(a, b) for a, b in itertools.combinations(range(len(values)), 2) if (values[a] ^ values[b]).bit_count() <= 3}
    for size, dense in ((2000, 4096), (64, 4096), (64, 100)):
        monkeypatch.setattr(common, "DENSE", dense)
        found, groups = common.bucket_links(_signed(spark, values), [_by_block, _by_rest], _within_three, lambda pairs: pairs, size)
        assert {tuple(r) for r in found.collect()} == want and len(want) >= 600
        assert {r["node"]: r["component"] for r in groups.collect()} == _components(range(len(values)), want)


def test_groups_of_dense_buckets(spark, monkeypatch):
    """Families that share all blocks but the last bits, and links that only some pairs have: groups as of all pairs."""
    random.seed(16)
    values = [random.choice([0, 7 << 40, 0xFFFF << 80]) ^ random.getrandbits(9) for _ in range(500)]
    edges = [(a, b) for a, b in itertools.combinations(range(len(values)), 2) if (values[a] ^ values[b]).bit_count() <= 3 and (a + b) % 7 == 0]
    want = _components(range(len(values)), edges)
    for size, rare, dense in ((1000, False, 4096), (16, True, 4096), (16, True, 32)):
        monkeypatch.setattr(common, "DENSE", dense)
        monkeypatch.setattr(common, "CHUNK", 16)
        _, groups = common.bucket_links(_signed(spark, values), [_by_block, _by_rest], _within_three, lambda pairs: pairs.where("(a + b) % 7 = 0"), size, rare=rare)
        got = {r["node"]: r["component"] for r in groups.collect()}
        assert all(got.get(i, i) == want[i] for i in want)


def test_parities_lose_no_link():
    """Texts that reach the similarity never differ in more parities than it allows."""
    random.seed(18)
    checked = 0
    for base in _texts(19, 60, 60):
        copy = list(base)
        for _ in range(random.randint(0, 5)):
            copy[random.randrange(len(copy))] = random.choice(["new", "w1", "other"])
        texts = [" ".join(base), " ".join(copy)]
        s = near_duplicates.sketches(texts)
        k = near_duplicates.SKETCHES + near_duplicates.LANES
        differ = sum((int(x) ^ int(y) & (1 << 64) - 1).bit_count() if x != y else 0 for x, y in zip(*s[:, k:-1].astype("uint64")))
        a, b = near_duplicates.shingle_lists(texts)
        assert list(s[:, -1]) == [len(a), len(b)]
        if near_duplicates.aligned(a, b):
            checked += 1
            assert differ <= (len(a) + len(b)) / 9 + 1e-9
    assert checked > 20


def test_templates_with_a_near_copy_each(spark, documents, monkeypatch):
    """Texts of one template that are no copies of each other (below the threshold), each with one near copy."""
    random.seed(17)
    fixed, rows = [f"t{i}" for i in range(180)], []
    for k in range(120):
        own = [*fixed, *[f"k{k}x{i}" for i in range(30)]]
        copy = list(own)
        copy[random.randrange(10, 160)] = "changed"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(copy))]
    lists = near_duplicates.shingle_lists([t for _, t in rows])
    edges = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if near_duplicates.aligned(lists[a], lists[b]) > 0]
    assert {(2 * k, 2 * k + 1) for k in range(120)} <= set(edges) and len(edges) < 2000
    for dense in (4096, 40):  # compared in chunks, or split
        monkeypatch.setattr(common, "DENSE", dense)
        got = {r["doc_id"]: r["class_id"] for r in near_duplicates.classes(documents(rows)).collect()}
        assert got == _components(range(len(rows)), edges)


def test_names_that_clash(spark, documents):
    rows = documents([(1, "one line here\nand two"), (2, "one line here"), (None, None)])
    odd = rows.select("*", F.lit(1).alias("gone"), F.lit(2).alias("__gone"), F.lit(3).alias("N_LINES"), F.lit(4).alias("node"), F.lit(5).alias("class_id"))
    out = line_dedup.stage(spark, odd, "")
    assert out.columns == odd.columns and sorted(map(str, [r["text"] for r in out.collect()])) == ["", "None", "one line here\nand two"]
    assert near_duplicates.keep_one(odd).columns == odd.columns


def test_lines_of_an_empty_table(spark, documents):
    assert line_dedup.dedup_lines(documents([])).count() == 0
    assert near_duplicates.classes(documents([])).count() == 0


def test_warc_round_trip(spark, folder):
    """Payloads hold magic, whole fake heads and line ends, over splits of a few kilobytes."""
    random.seed(6)
    m = warc.MAGIC
    odd = [None, "", "short", m, m + m, f"a{m}WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n{m}", f"x\r\n\r\n{m}\r\n\r\n", f"{m}Content-Length: 99999999999999999999999\r\n\r\n", "WARWARC/1.1\r\n"]
    rows = [(i, f"http://x/{i}\r\n", random.choice(odd) if i % 3 else "é" * random.randint(0, 2000) + m * random.randint(0, 40) + "z" * random.randint(0, 5000)) for i in range(90)]
    rows.append((500, None, "é" * 30_000 + m))
    d = folder(pages=spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        got = {r["page_id"]: r for r in warc.op3_warc(spark, d).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        f = first.setdefault(data, i)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), digest, "response" if f == i else "revisit", None if f == i else f)
        assert r["digest_verified"] in (True, None)
    assert len(got) == len(rows)


def test_chat_roles(spark, folder):
    random.seed(7)
    rows = [(c, t, "assistant" if t % 2 else "user", f"words {c} {t}\nmore?" if t % 3 else "one line") for c in range(40) for t in range(random.randint(2, 7))]
    rows += [(90, 0, "user", None), (90, 1, "assistant", "")]
    d = folder(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["turn"]): r["role"] for r in chat.op4_chat(spark, d).collect()}
    right = sum(got.get((c, t)) == role for c, t, role, _ in rows)
    assert right / len(rows) > 0.95


def test_chat_does_not_depend_on_ranges(spark):
    """One transcript over all rows: the same states from one task and from many."""
    random.seed(8)
    rows = [(1, i, random.choice(["User: hi", "more", "", "Assistant: yes", "what?", "long " * 50])) for i in range(300)]
    lines = spark.createDataFrame(rows, "conv_id long, place long, line string")
    labelled = spark.createDataFrame([(1, 0, 0, "User: a", "user"), (1, 1, 0, "Assistant: b", "assistant"), (1, 1, 1, "c", "assistant"), (1, 2, 0, "User: d?", "user")], "conv_id long, turn long, place int, line string, role string")
    model = chat.fit(labelled)
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted((r["place"], r["line"], chat.ROLES.index(r["role"]) * 3 + chat.KINDS.index(r["kind"])) for r in chat.parse(lines, model).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    symbols = [r["o"] for r in lines.orderBy("place").select(chat.symbol(F.col("line")).alias("o")).collect()]

    def likelihood(rows):
        s = [r[2] for r in rows]
        return model.start[s[0]] + sum(model.step[a, b] for a, b in zip(s, s[1:], strict=False)) + sum(model.emit[k, o] for k, o in zip(s, symbols, strict=True))

    best = (model.start + model.emit[:, symbols[0]])[:, None]
    for o in symbols[1:]:
        best = (best + model.step).max(axis=0)[:, None] + model.emit[:, [o]]
    assert len(got[0]) == len(got[1]) == 300
    assert abs(likelihood(got[0]) - best.max()) < 1e-6 and abs(likelihood(got[1]) - best.max()) < 1e-6
    text = chat.render(chat.parse(lines.select("conv_id", "place", F.col("line")), model))
    assert text.agg(F.sum("n_lines")).first()[0] == 300
