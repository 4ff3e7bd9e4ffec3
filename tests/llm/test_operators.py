"""Each operator against a plain version on small tables, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridemap.llm import decontaminate, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, sstable, substring_dedup, token_output, toxicity, url_filter

SMALL = "/root/testdata/sf0.001"
LOWER = {k: k + 32 for k in range(65, 91)}
WORDS = [f"{a}{b}" for a in "abcdefgh" for b in "klmnop"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def by_id(frame, key="doc_id"):
    return {r[key]: r for r in frame.collect()}


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return docs, spark.read.parquet(f"{SMALL}/benchmark.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


# ---- decontamination ------------------------------------------------------------------------------------------------


def hits(texts, items, window=10):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for name, text in items:
        words = rx.findall((text or "").translate(LOWER))
        for k in range(max(1, len(words) - window + 1) if words else 0):
            windows[tuple(words[k : k + window])].add(name)
    sizes = {len(w) for w in windows}
    for text in texts:
        words = rx.findall((text or "").translate(LOWER))
        flags, found = [False] * len(words), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if own := windows.get(tuple(words[k : k + n])):
                    flags[k : k + n] = [True] * n
                    found |= own
        yield len(words), sum(flags), sorted(found)


def test_fm_index_finds_what_a_scan_finds(spark, small):
    docs, benchmark, _ = small
    items = [(str(r["item_id"]), r["text"]) for r in benchmark.collect()]
    rows = docs.select("doc_id", "text").collect()
    got = by_id(decontaminate.find_contamination(docs, benchmark))
    some = 0
    for row, want in zip(rows, hits([r["text"] for r in rows], items), strict=True):
        r = got[row["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["items"]) == want
        raw = (row["text"] or "").encode()
        assert sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw[s["start"] : s["end"]].decode())) for s in r["spans"]) == want[1]
        some += bool(want[1])
    assert some


def test_short_items_repeats_blocks_and_overlaps(spark):
    items = [(1, "Alpha beta"), (2, "b a b a b a b a b a b a"), (3, None), (4, " ,. "), (5, "alpha BETA"), (6, "é1 x"), (None, "zz")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    texts = ["ALPHA, beta! alpha", "a b a b a b a b a b a b a", "é1x é1 x", "alpha", "", None, "beta alpha beta zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = list(hits(texts, [(str(k), t) for k, t in items if k is not None]))
    for block in (1, 1 << 20):
        got = by_id(decontaminate.find_contamination(docs, benchmark, block_bytes=block, shard_bytes=16))
        assert [(got[k]["n_words"], got[k]["n_hit"], got[k]["items"]) for k in range(len(texts))] == want


def test_one_block_is_held_at_a_time(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, prose(rng, 14)) for k in range(12)]
    texts = [prose(rng, 10) + " " + items[k % 12][1] + " " + items[(k + 5) % 12][1] + " " + prose(rng, 10) for k in range(40)] + ["", None]
    open_, most, send = [], [], spark.sparkContext.broadcast

    class Sent:
        def __init__(self, value):
            self.own = send(value)
            open_.append(self)
            most.append(len(open_))

        def __getattr__(self, name):
            return getattr(self.own, name)

        def destroy(self):
            open_.remove(self)
            self.own.destroy()

    real = decontaminate.searched

    def searched(rows, block, shard_bytes):
        found, sent = real(rows, block, shard_bytes)
        keeper = Sent(None)
        keeper.own = sent
        return found, keeper

    monkeypatch.setattr(decontaminate, "searched", searched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = by_id(decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=100, shard_bytes=3000))
    want = list(hits(texts, [(str(k), t) for k, t in items]))
    assert [(got[k]["n_words"], got[k]["n_hit"], got[k]["items"]) for k in range(len(texts))] == want
    assert len(most) >= 6 and max(most) == 1 and not open_


def test_random_sequences_in_the_index():
    rng = np.random.Generator(np.random.PCG64(3))
    for size, alphabet in ((0, 3), (1, 2), (300, 3), (2000, 5), (500, 2)):
        symbols = np.append(rng.integers(0, alphabet, size), 0)
        order = decontaminate.suffix_array(symbols)
        assert sorted(order.tolist()) == list(range(len(symbols)))
        index = decontaminate.FMIndex(symbols, alphabet)
        text = symbols.tolist()
        for n in (1, 2, 5):
            words = rng.integers(1, max(2, alphabet), (6, n))
            low, high = index.search(words, np.full(6, n))
            for w, a, b in zip(words.tolist(), low, high, strict=True):
                places = sorted(index.locate(np.arange(a, b)).tolist()) if b > a else []
                assert places == [k for k in range(len(text) - n + 1) if text[k : k + n] == w]


def test_decontamination_of_odd_rows(spark, odd_rows, no_rows, small):
    benchmark = spark.createDataFrame([(1, "three four five six seven eight nine ten eleven twelve")], "item_id bigint, text string")
    got = decontaminate.find_contamination(odd_rows, benchmark).collect()
    assert len(got) == odd_rows.count() and all(r["n_hit"] == 80 for r in got if r["doc_id"] in (5, 6, 10))
    assert decontaminate.find_contamination(no_rows, benchmark).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.find_contamination(odd_rows, benchmark.where("false")).collect())


# ---- near-duplicates ------------------------------------------------------------------------------------------------


def components_of(rows, k=3, percent=85):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(words)} if 0 < len(words) < k else {tuple(words[j : j + k]) for j in range(len(words) - k + 1)})
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    least = {}
    for a in range(len(rows)):
        least[root(a)] = min(least.get(root(a), rows[a][0]), rows[a][0])
    return {rows[a][0]: (len(sets[a]), least[root(a)]) for a in range(len(rows))}


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(11)
    rows = []
    for group in range(6):
        base = prose(rng, 120).split()
        for copy in range(25):
            words = list(base)
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((1000 - len(rows), " ".join(words)))
    chain = prose(rng, 100).split()
    for step in range(12):  # a chain whose ends are unlike
        rows.append((2000 + step, " ".join(chain)))
        for _ in range(2):
            chain[rng.randrange(len(chain))] = f"new{step}"
    rows += [(3000, "A b"), (3001, "a B"), (3002, "a"), (3003, ""), (3004, " "), (3005, "a b c"), (3006, "a b")]
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=3, percent=85, bands=24))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == components_of(rows)


def test_odd_sketch_of_a_set_is_a_lower_bound():
    hasher = near_dedup.Hasher(4, 2)
    rng = np.random.Generator(np.random.PCG64(1))
    for n in (0, 1, 50, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n + 10, dtype=np.uint64))
        b = np.unique(np.concatenate((a[n // 5 :], rng.integers(0, 1 << 63, n // 5, dtype=np.uint64))))
        apart = int(np.bitwise_count(hasher.set_sketch(a) ^ hasher.set_sketch(b)).sum())
        assert apart <= len(np.setxor1d(a, b))


def boilerplate(n, seed=1):
    """Texts with the same long passage, unlike enough in the rest not to be linked: similarity of about 0.75."""
    rng = random.Random(seed)
    shared = prose(rng, 240)
    return [(k, shared + " " + " ".join(f"own{k}x{j}" for j in range(38))) for k in range(n)]


def test_shared_boilerplate_is_linear(spark, monkeypatch):
    made = []
    for name in ("alike", "prefix_pairs"):
        real = getattr(near_dedup, name)

        def counted(first, *rest, real=real, name=name):
            out = real(first, *rest)
            made.append((name, (first if name == "alike" else out).count()))
            return out

        monkeypatch.setattr(near_dedup, name, counted)
    totals = []
    for n in (150, 300):
        made.clear()
        got = near_dedup.near_duplicates(spark.createDataFrame(boilerplate(n), "doc_id bigint, text string"), k=3, percent=85, bands=24)
        assert got.where("component_id <> doc_id").count() == 0
        assert [x for name, x in made if name == "prefix_pairs"] == [0]  # reached, and no pair was made
        totals.append(sum(x for _, x in made))
    assert totals[1] <= 2.5 * totals[0]


def test_prefixes_find_all_links(spark):
    rng = random.Random(21)
    rows = []
    for base in range(12):
        words = prose(rng, 90).split()
        for _ in range(8):
            own = list(words)
            for _ in range(rng.randrange(1, 8)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(60)}"
            rows.append((len(rows), " ".join(own[: rng.randrange(80, 91)])))
    docs = spark.createDataFrame(rows, "id bigint, text string")
    sets = near_dedup.full_sets(docs, docs.select("id"), 3, 1 << 20, 10**6)
    members = docs.select(F.col("id").alias("c"), F.col("id").alias("part"))
    pairs = {tuple(r) for r in near_dedup.prefix_pairs(members, sets, 85).collect()}
    plain = {}
    for key, text in rows:
        words = text.split()
        plain[key] = {tuple(words[j : j + 3]) for j in range(len(words) - 2)}
    want = {(a, b) for a in plain for b in plain if a < b and 100 * len(plain[a] & plain[b]) >= 85 * len(plain[a] | plain[b])}
    assert want and want <= pairs and len(pairs) < 3 * len(want) + 50


def test_recall_on_some_thousand_rows(spark):
    """Of all links between neighbours of many small groups at every similarity from the threshold up, components lose none."""
    rng = random.Random(33)
    rows = []
    for _ in range(900):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 120))]
        for _ in range(4):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=3, percent=85, bands=24))
    for a in range(0, len(rows), 4):
        want = components_of(rows[a : a + 4])
        assert {k: (got[k]["n_shingles"], got[k]["component_id"]) for k in want} == want


def test_near_duplicates_of_odd_rows(spark, odd_rows, no_rows):
    got = near_dedup.near_duplicates(odd_rows, k=3, percent=85).collect()
    assert len(got) == odd_rows.count()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(k, {6: 5, 10: 5}.get(k, k)) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None)}
    assert near_dedup.near_duplicates(no_rows).count() == 0


# ---- substrings -----------------------------------------------------------------------------------------------------


def removed_of(texts, length):
    count = collections.Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    for b in texts:
        flags = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                flags[k : k + length] = [True] * length
        runs = [k for k in range(len(b)) if flags[k] and (k == 0 or not flags[k - 1])]
        yield len(b), sum(flags), len(runs), hashlib.sha256(bytes(x for x, f in zip(b, flags, strict=True) if not f)).hexdigest()


@pytest.mark.parametrize(("length", "blob_bytes", "name_bits"), [(12, 0, 64), (40, 10**9, 64), (200, 0, 64), (200, 10**9, 64), (40, 0, 9), (40, 10**9, 9), (200, 0, 14)])
def test_substrings_equal_a_scan(spark, length, blob_bytes, name_bits):
    """As blobs and as rows; with so few bits of names that unlike strings have equal names."""
    rng = random.Random(length)
    passages = [prose(rng, length) for _ in range(3)]
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(20)]
    for k in range(20):  # passages at any place, cut at any place
        text = prose(rng, 30)
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            at = rng.randrange(len(text))
            text = text[:at] + p[a : a + rng.randrange(length - 3, 2 * length)] + text[at:]
        texts.append(text)
    texts += [texts[3], texts[3], "ab" * length, "", None, "x" * (length - 1), "é" * length, "y" * length]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = by_id(substring_dedup.repeated_spans(docs, length=length, chunk_bytes=700, blob_bytes=blob_bytes, name_bits=name_bits, broadcast_bytes=blob_bytes, with_kept=True))
    for k, want in enumerate(removed_of([(t or "").encode() for t in texts], length)):
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) == want
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == want[3]


def test_every_difference_is_in_the_cover():
    for q in (2, 3, 5, 7, 11, 13):
        v = q * q + q + 1
        d = substring_dedup.difference_cover(q)
        assert len(d) == q + 1 and {(a - b) % v for a in d.tolist() for b in d.tolist()} == set(range(v))


def test_substrings_of_odd_rows(odd_rows, no_rows):
    got = substring_dedup.repeated_spans(odd_rows).collect()
    assert len(got) == odd_rows.count()
    assert all(r["n_removed"] == r["n_bytes"] for r in got if r["doc_id"] in (5, 6, 10)) and all(r["n_removed"] == 0 for r in got if r["doc_id"] in (1, 2, 3, 4))
    assert substring_dedup.repeated_spans(no_rows).count() == 0


# ---- token output ---------------------------------------------------------------------------------------------------


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def crc_rows(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    start, out = 0, {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out[key] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_shards_round_trip(spark, small):
    docs = small[0]
    odd = ["a\x0bb\x0cc\x1cd\x85e\u00a0f\u2003g", "don't I'LL it's 's", "H\u0331 E\u0301 ΑΣ ΑΣ. ß Ÿ ÿ × ÷", "<|endoftext|> x<|startoftext|>y <|", "1234 a1b2 x,y;z!! ###", "日本語 ١٢ 👍🏽", "\x00 \x7f \ufeff", " \n\t\r ", "ÀÉ-naïve/Çà"]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(-5 - k, t) for k, t in enumerate(odd)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    manifest = token_output.write_shards(frame, vocabulary(), shard_bytes=20_000)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.read_shards(manifest).collect()}
    assert got == crc_rows(rows)
    assert manifest.count() > 4
    first = manifest.orderBy("part", "seq").first()
    from stridemap.llm import storage

    with storage.open_read(first["path"]) as file:
        table = sstable.Reader(file)
        entries = list(table.scan())
        assert [k for k, _ in entries] == sorted(k for k, _ in entries) and len(entries) == first["n_docs"]
        for key, value in entries[:5]:
            assert table.get(key) == [value]
        assert table.get(token_output.encode_key(10**12)) == []


@pytest.mark.parametrize("change", [
    lambda n: n["normalizers"].pop(2),  # cased
    lambda n: n["normalizers"].insert(0, {"type": "Replace", "pattern": {"String": "a"}, "content": "b"}),
    lambda n: n["normalizers"][1].update(content=""),
])
def test_other_normalisers_are_respected(spark, tmp_path, change):
    import json

    from tokenizers import Tokenizer

    spec = json.loads(open(vocabulary()).read())
    change(spec["normalizer"])
    path = str(tmp_path / "other.json")
    open(path, "w").write(json.dumps(spec))
    assert not token_output.check_white_space(Tokenizer.from_file(path)) and token_output.check_white_space(Tokenizer.from_file(vocabulary()))
    rows = [(1, "Hello World, a  banana\nNEW line"), (2, ""), (3, "ÀÉ-Naïve <x> it's")]
    got = {r["doc_id"]: r["ids_crc32"] for r in token_output.read_shards(token_output.write_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), path)).collect()}
    tokenizer = Tokenizer.from_file(path)
    assert got == {k: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, t in rows}


def test_addresses_of_files():
    from stridemap.llm import storage

    assert storage._local("file:///a%20b") == "/a b" and storage._local("/x") == "/x" and storage._local("s3a://b/k") is None


def test_table_blocks_filter_and_repeats(tmp_path):
    path = tmp_path / "t.sst"
    keys = sorted(token_output.encode_key(k) for k in (None, -3, 0, 7, 7, 7, 2**40, *range(100, 400)))
    writer = sstable.Writer(path.open("wb"), block_bytes=64)
    for n, key in enumerate(keys):
        writer.add(key, bytes([n % 251]) * (n % 9))
    writer.close()
    with path.open("rb") as file:
        table = sstable.Reader(file)
        assert len(table.blocks) > 10 and [k for k, _ in table.scan()] == keys
        assert len(table.get(token_output.encode_key(7))) == 3 and table.get(token_output.encode_key(8)) == []
    assert [token_output.decode_key(token_output.encode_key(k)) for k in (None, -3, 2**40, "é")] == [None, -3, 2**40, "é"]
    absent = sum(table.bloom.may_have(token_output.encode_key(k)) for k in range(10_000, 12_000))
    assert absent < 60
    damaged = bytearray(path.read_bytes())
    damaged[3] ^= 255
    path.write_bytes(bytes(damaged))
    with path.open("rb") as file, pytest.raises(ValueError):
        list(sstable.Reader(file).scan())


def test_tokens_of_odd_rows(odd_rows, no_rows):
    got = token_output.read_shards(token_output.write_shards(odd_rows, vocabulary())).orderBy("start").collect()
    assert len(got) == odd_rows.count()
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in odd_rows.collect()), key=lambda k: (k is not None, k))
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert token_output.read_shards(token_output.write_shards(no_rows, vocabulary())).count() == 0


# ---- lines ----------------------------------------------------------------------------------------------------------


def test_templates(spark):
    texts = [f"my own line {w}\nLogged in user {w} from host {100 + k} at noon\nunique {w} words here {w}{w} only now and then" for k, w in enumerate(WORDS[:8])]
    texts += ["short\nshort", "x y z\n\n", None, ""]
    docs = spark.createDataFrame([(k, t, "s", 5) for k, t in enumerate(texts)], "doc_id bigint, text string, n_lines string, d_mark int")
    got = by_id(line_dedup.drop_recurring_lines(docs, least=4))
    for k in range(8):
        assert got[k]["text"] == "\n".join(texts[k].split("\n")[::2]) and got[k]["n_lines"] == 3 and got[k]["n_dropped"] == 1
    assert got[8]["text"] == "short\nshort"  # one document only
    assert got[9]["text"] == "x y z\n\n" and got[9]["n_lines"] == 3
    assert got[10]["text"] is None and got[11]["text"] == "" and got[0]["d_mark"] == 5


def rest_of(row):
    """What must pass through: all but the text and the counts."""
    return repr(sorted((k, v) for k, v in row.asDict().items() if k not in ("text", "n_lines", "n_dropped")))


def test_a_line_of_two_documents_goes_at_the_usual_settings(spark):
    texts = ["own a b c\nThe shared line of two\nown d", "first x\n The  shared line of two \nlast y", "call 555 now\nq", "call 555 now\nr", "call 777 now\ns", "a alone\na alone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = by_id(line_dedup.drop_recurring_lines(docs))
    assert [got[k]["text"] for k in range(6)] == ["own a b c\nown d", "first x\nlast y", "q", "r", "call 777 now\ns", "a alone\na alone"]


def test_many_dropped_lines_of_one_document(spark):
    lines = [f"line {WORDS[k % 48]} {WORDS[k // 48 % 48]} {WORDS[k // 2304 % 48]}" for k in range(20_000)]
    docs = spark.createDataFrame([(1, "\n".join(["top", *lines, "end"])), (2, "\n".join(["start", *lines]))], "doc_id bigint, text string")
    got = by_id(line_dedup.drop_recurring_lines(docs))
    assert (got[1]["text"], got[2]["text"], got[1]["n_dropped"]) == ("top\nend", "start", 20_000)


def test_lines_of_odd_rows(odd_rows, no_rows):
    got = line_dedup.drop_recurring_lines(odd_rows, least=3)
    assert got.count() == odd_rows.count() and got.columns == [*(c for c in odd_rows.columns if c != "n_lines"), "n_lines", "n_dropped"]
    assert sorted(map(rest_of, got.collect())) == sorted(map(rest_of, odd_rows.collect()))
    assert {r["text"] for r in got.where("doc_id in (5, 6, 10)").collect()} == {""}
    assert line_dedup.drop_recurring_lines(no_rows).count() == 0


def test_shuffled_sides_give_the_same(spark, small):
    near = line_dedup.drop_recurring_lines(small[0], least=3).select("doc_id", "text", "n_dropped")
    far = line_dedup.drop_recurring_lines(small[0], least=3, broadcast_rows=0).select("doc_id", "text", "n_dropped")
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))
    assert near.agg(F.sum("n_dropped")).first()[0] > 0


# ---- quality --------------------------------------------------------------------------------------------------------


def base_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(zip(words, words[1:], words[2:]))
    flags = [False] * len(words)
    for k in range(len(words) - 2):
        if count[tuple(words[k : k + 3])] > 1:
            flags[k : k + 3] = [True] * 3
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, sum(flags)


def test_statistics_equal_a_scan(spark, small):
    texts = [r["text"] for r in small[0].collect()] + ["a b c a b c", "x\nx\n\n\nx ", "\n", "", None, "\x00\x00 é€👍 |<>|", "a\na", "q\r\nq\r\n q", "Aa aA\n" * 7]
    docs = spark.createDataFrame([(k, t, None, None) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    got = by_id(quality_rules.base_statistics(docs, "doc_id", "text", ["lang"]), "id")
    for k, text in enumerate(texts):
        assert tuple(got[k][s] for s in quality_rules.STATS[:5]) == base_of(text)


def test_outliers_are_rejected_and_the_bulk_is_kept(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(rng.randrange(80, 400))), "en", f"s{k % 3}") for k in range(450)]
    bad = {450 + k for k in range(12)}
    rows += [(k, " ".join(rng.choice(WORDS).upper() + "%%%" + str(rng.randrange(400)) for _ in range(200)), "en", "s1") for k in sorted(bad)]
    rows += [(900, "too short", "en", "s1"), (901, "again and again " * 60, "xx", "lonely"), (902, rows[0][1], "xx", "lonely")]
    got = by_id(quality_rules.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")))
    assert not any(got[k]["kept"] for k in bad) and sum(got[k]["kept"] for k in range(450)) >= 448
    assert got[900]["base_failed"] and got[901]["base_failed"] and not got[902]["base_failed"] and got[902]["kept"]


def direct_mcd(x, h, starts=200):
    """The least log determinant of h rows by concentration steps from many random starts, and the place of those rows."""
    rng, best = np.random.default_rng(0), (np.inf, None)
    for _ in range(starts):
        own = rng.choice(len(x), x.shape[1] + 1, replace=False)
        last = np.inf
        while True:
            mean, scatter = x[own].mean(axis=0), np.cov(x[own].T, bias=True) + 1e-9 * np.eye(x.shape[1])
            own = np.argsort(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(scatter), x - mean), kind="stable")[:h]
            now = np.linalg.slogdet(np.cov(x[own].T, bias=True))[1]
            if now >= last - 1e-9:
                break
            last = now
        if last < best[0]:
            best = (last, x[own].mean(axis=0))
    return best


def test_estimates_are_those_of_a_direct_search(spark):
    rng = np.random.default_rng(3)
    names = list(quality_rules.VECTOR)
    turn = rng.normal(size=(7, 7)) * 2 + 3 * np.eye(7)
    bulk = rng.normal(size=(900, 7)) @ turn + 5
    odd = rng.normal(size=(200, 7)) * 0.5 + np.array([40, -30, 20, 0, 10, -40, 15])  # a tight cluster, which means and covariances follow
    x = np.concatenate((bulk, odd))
    rows = spark.createDataFrame([(*map(float, r), ["a", "b", "*"]) for r in x], ", ".join(f"{n} double" for n in names) + ", groups array<string>")
    got = quality_rules.robust_estimates(rows, names, 0.75, 1e-3, 100).where("level = 0").first()
    log_det, mean = direct_mcd(x, int(np.ceil(0.75 * len(x))))
    assert got["log_det"] <= log_det + 0.1 and got["steps"] > 1
    factor = np.array(got["factor"]).reshape(7, 7)
    apart = lambda p: ((factor @ (p - np.array(got["mean"])).T) ** 2).sum(axis=0) / got["scale"]
    limit = quality_rules.chi_square_quantile(0.999, 7)
    assert apart(mean[None])[0] < 0.05 and (apart(odd) > limit).all() and (apart(bulk) <= limit).mean() > 0.97


def test_estimates_joined_by_a_shuffle_are_the_same(spark, small):
    near, far = (quality_rules.quality(small[0], broadcast_groups=n).select("doc_id", "kept", F.round("distance", 6)).collect() for n in (10**6, 0))
    assert sorted(map(tuple, near), key=repr) == sorted(map(tuple, far), key=repr)


def plain_shares(rows):
    """Posterior shares of (host, path) by the formulas, level by level."""
    prior = (sum(g for _, _, g in rows) + 1) / (len(rows) + 2)
    shares = {}
    for depth in (1, 2):
        groups = collections.defaultdict(list)
        for *keys, g in rows:
            groups[tuple(keys[:depth])].append(g)
        parent = {k: prior if depth == 1 else shares[k[:1]] for k in groups}
        s = sum(len(g) * (sum(g) / len(g) - parent[k]) ** 2 for k, g in groups.items())
        v = sum(len(g) * parent[k] * (1 - parent[k]) for k, g in groups.items())
        chance = len(groups) / len(rows)
        excess = min(max((s / v - chance) / (1 - chance), 1e-4), 1 / 6)
        m = (1 - excess) / excess
        shares |= {k: (sum(g) + m * parent[k]) / (len(g) + m) for k, g in groups.items()}
    return {k: v for k, v in shares.items() if len(k) == 2}


def test_posteriors_equal_a_plain_version(spark):
    rng = random.Random(12)
    rows = [(h := rng.choice("aaabcdeeeeeee"), h + rng.choice("xxxyz"), rng.choice([0.0, 1.0, 1.0, 0.25]) * (h != "c")) for _ in range(600)]
    got = quality_classifier.shrunk_shares(spark.createDataFrame(rows, "k0 string, k1 string, good double"), ["k0", "k1"]).collect()
    want = plain_shares(rows)
    assert len(got) == len(want) and all(abs(r["share"] - want[r["k0"], r["k1"]]) < 1e-9 for r in got)


def test_words_are_evidence_of_quality(spark):
    rng = random.Random(13)
    rows = [(k, prose(rng, 40) + (" splendid" if k % 2 else " rubbish") + " " + prose(rng, 40), "s", "en", k % 2) for k in range(500)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, quality int")
    got = quality_classifier.classify(frame.drop("quality"), frame.select("doc_id", "quality")).join(frame.select("doc_id", "quality"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.95


def test_quality_of_odd_rows(odd_rows, no_rows, odd_labels):
    got = quality_rules.quality(odd_rows).collect()
    assert len(got) == odd_rows.count() and all(not r["kept"] for r in got if r["base_failed"])
    assert quality_rules.quality(no_rows).count() == 0
    scored = quality_classifier.classify(odd_rows, odd_labels)
    assert scored.count() == odd_rows.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_classifier.classify(no_rows, odd_labels).count() == 0
    assert quality_classifier.classify(odd_rows, odd_labels.where("false")).count() == odd_rows.count()


def test_chi_square_quantiles():
    # from tables
    assert abs(quality_rules.chi_square_quantile(0.95, 7) - 14.067) < 0.05
    assert abs(quality_rules.chi_square_quantile(0.5, 7) - 6.346) < 0.02


def test_sparse_sites_shrink(spark):
    rows = [("a", "x", 1.0)] * 400 + [("b", "x", 0.0)] * 400 + [("c", "x", 0.0)] * 2 + [("a", "y", 0.0)]
    got = {(r["k0"], r["k1"]): r["share"] for r in quality_classifier.shrunk_shares(spark.createDataFrame(rows, "k0 string, k1 string, good double"), ["k0", "k1"]).collect()}
    assert got[("a", "x")] > 0.95 and got[("b", "x")] < 0.05
    assert got[("b", "x")] < got[("c", "x")] < 0.5 and got[("a", "y")] > 0.5  # two and one documents say little


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.classify(docs, labels).join(labels, "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.95


# ---- urls -----------------------------------------------------------------------------------------------------------


def test_rules_and_parts(spark):
    urls = ["http://WWW.Example.com/en/1", "http://example.com/en/x", "https://a.net/es/", "http://net/fr/x?y#z", "http://xnet/es/", "ftp://h?q/es/", "no scheme/en/", None, "http://a.net/es", "http://b.com", "x://y://a.com/", "http://a.com/#://b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = by_id(url_filter.filter_urls(pages), "page_id")
    want = [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("example.com", "/en/x", "example.com/en/", "block"), ("a.net", "/es/", "net/es/", "block"), ("net", "/fr/x", "net/fr/", "block"),
        ("xnet", "/es/", None, "allow"), ("h", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.net", "/es", None, "allow"), ("b.com", "", None, "allow"), ("y:", "//a.com/", None, "allow"), ("a.com", "/", "com/", "allow"),
    ]
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) for k in range(len(urls))] == want


def test_templates_are_judged_by_purity(spark):
    rows = []
    for k in range(40):
        rows += [(f"http://h.org/shop/{k}", "block" if k % 10 else None), (f"http://h.org/buy/{k}", "block" if k < 30 else None), (f"http://h.org/docs/{k}", "allow" if k % 2 else None), (f"http://h.org/u/{WORDS[k]}/page", "block" if k < 20 else None), (f"http://other.org/shop/{k}", None)]
    pages = spark.createDataFrame([(k, u, lab, "x") for k, (u, lab) in enumerate(rows)], "page_id bigint, url string, given string, host string")
    got = url_filter.filter_urls(pages, label_col="given", most_branches=20).join(pages.select("page_id", "url"), "page_id").collect()
    verdict = lambda part: {r["verdict"] for r in got if part in r["url"]}
    assert verdict("h.org/shop/") == {"block"} and verdict("h.org/buy/") == {"block"} and verdict("h.org/docs/") == {"allow"} and verdict("other.org") == {"allow"}
    assert verdict("h.org/u/") == {"block"} and {r["template"] for r in got if "/u/" in r["url"]} == {"/u/*/page"}
    assert url_filter.filter_urls(pages.where("false")).count() == 0


def test_deep_paths_and_nested_wide_nodes(spark):
    urls = [f"http://h.org/{WORDS[k]}/mid/{WORDS[(k * 7 + j) % 48]}/end" for k in range(30) for j in range(3)] + ["http://h.org/" + "/".join(f"s{'x' * (k % 5)}" for k in range(2000)), "http://h.org/a//b/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id bigint, url string")
    got = by_id(url_filter.filter_urls(pages, most_branches=20), "page_id")
    assert {got[k]["template"] for k in range(90)} == {"/*/mid/*/end"}
    assert got[90]["template"].count("/") == 2000 and got[91]["template"] == "/*/b"


def test_query_labels_reach_pages_without_rules(spark):
    from stridemap.llm.queries import op6_url_filter

    got = op6_url_filter(spark, "/root/testdata/sf0.1").where("rule is null")
    assert got.where("verdict = 'block'").count() > 0 and got.where("verdict = 'allow'").count() > 100


# ---- mixing ---------------------------------------------------------------------------------------------------------


def targets_of(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, left, free = {}, float(sum(sizes.values())), set(order)
    while True:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not above:
            return out | {s: left * weight[s] / total for s in free}
        for s in above:
            out[s] = 3.0 * sizes[s]
            free.discard(s)
        left = float(sum(sizes.values())) - sum(out.values())


def test_mix_meets_targets(spark):
    rng = random.Random(8)
    rows = [(k, prose(rng, rng.choice((3, 40, 200, 900))), rng.choice(["a", "a", "a", "a", "B", "é", None, "c"])) for k in range(1500)] + [(5000, "tiny", "zz"), (5001, None, "a"), (5002, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs)
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.repartition(7)).collect()}
    found = got.collect()
    assert {r["doc_id"]: r["copies"] for r in found} == again
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want, taken = targets_of(sizes), collections.Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= max(3, 0.01 * want[s]) for s in sizes)
    assert all(r["copies"] <= 3 for r in found if not r["size"])
    mixed = mixing.mixed_documents(docs, got)
    counts = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert all(counts[r["doc_id"]] == r["copies"] for r in found) and mixed.columns == docs.columns


def test_copies_of_empty_documents(spark):
    rows = [(k, "", "a") for k in range(6)] + [(10, "x y", "a"), (11, " ".join(["w"] * 400), "b"), (12, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = by_id(mixing.mix(docs))
    assert max(r["copies"] for r in got.values()) <= 3 and got[10]["copies"] == 3 and got[12]["copies"] == 0
    far = by_id(mixing.mix(docs, broadcast_sources=0))
    assert {k: tuple(r) for k, r in far.items()} == {k: tuple(r) for k, r in got.items()}


def test_mixed_rows_are_the_documents_rows(odd_rows):
    mixed = mixing.mixed_documents(odd_rows, mixing.mix(odd_rows))
    assert {repr(r) for r in mixed.collect()} <= {repr(r) for r in odd_rows.collect()} and mixed.count() > 0


def test_mix_of_odd_rows(odd_rows, no_rows):
    got = mixing.mix(odd_rows)
    assert got.count() == odd_rows.count()
    assert mixing.mix(no_rows).count() == 0
    assert mixing.mixed_documents(odd_rows, got).columns == odd_rows.columns
    blank = mixing.mix(odd_rows.where("doc_id in (1, 2, 3)"))
    assert blank.where("target <> 0 or size <> 0").count() == 0


# ---- toxicity -------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.collect())
    right = got.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right >= 0.9
    # labels of held-out rows are not read
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r["doc_id"], r["score"]) for r in toxicity.toxicity(docs, turned).collect()} == {(r["doc_id"], r["score"]) for r in got.collect()}


def test_toxicity_of_odd_rows(odd_rows, no_rows, odd_labels):
    for labels in (odd_labels, odd_labels.where("false"), odd_labels.where("toxic = 1")):
        got = toxicity.toxicity(odd_rows, labels)
        assert got.count() == odd_rows.count() and got.where("score is null or score < 0 or score > 1 or held_out is null").count() == 0
    assert toxicity.toxicity(no_rows, odd_labels).count() == 0


def test_a_copied_passage_is_one_piece_of_evidence(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, 60) + (" vile" if k % 7 == 0 else "") + " " + prose(rng, 60), int(k % 7 == 0)) for k in range(700)]
    copied = prose(rng, 50) + " harmless " + prose(rng, 50)
    rows += [(10_000 + k, copied, 1) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    test = [(90_000, prose(rng, 80) + " vile " + prose(rng, 80)), (90_001, prose(rng, 80) + " harmless " + prose(rng, 80)), (90_002, prose(rng, 300))]
    docs = frame.select("doc_id", "text").union(spark.createDataFrame(test, "doc_id bigint, text string"))
    got = by_id(toxicity.toxicity(docs, frame.select("doc_id", "toxic")))
    assert got[90_000]["predicted"] == 1 and got[90_001]["predicted"] == 0 and got[90_002]["predicted"] == 0


def test_an_expression_after_one_word_counts_in_each_document(spark):
    rng = random.Random(3)
    rows = [(k, f"{prose(rng, 30)} you are a {'clown' if k % 4 == 0 else 'friend'} {prose(rng, 30)}", int(k % 4 == 0)) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    test = [(90_000 + k, f"{prose(rng, 30)} you are a {word} {prose(rng, 30)}") for k, word in enumerate(("clown", "friend"))]
    docs = frame.select("doc_id", "text").union(spark.createDataFrame(test, "doc_id bigint, text string"))
    got = by_id(toxicity.toxicity(docs, frame.select("doc_id", "toxic")))
    assert got[90_000]["predicted"] == 1 and got[90_001]["predicted"] == 0


def plain_evidence(rows, evidence=15.0):
    """e(before, word) by the formulas, from dictionaries."""
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    n = [collections.Counter(), collections.Counter()]  # ordinary, toxic
    for text, toxic in set(rows):
        words = rx.findall(text.translate(LOWER))
        n[toxic].update(set(zip([None, *words], words)))
    h_n, after, before = ([collections.Counter(), collections.Counter()] for _ in range(3))
    for c in (0, 1):
        for (h, w), k in n[c].items():
            h_n[c][h] += k
            after[c][h] += 1
            before[c][w] += 1
    both = collections.Counter(w for _, w in set(n[0]) | set(n[1]))
    totals, kinds, pairs = [sum(b.values()) for b in before], [len(b) for b in before], [sum(x.values()) for x in n]

    def s(counts, of):
        g = 2 * sum(x * math.log(x / (sum(counts) * y / sum(of))) for x, y in zip(counts, of, strict=True) if x)
        return 1 / (1 + math.exp((evidence - g) / 2))

    lower = lambda c, w: (max(before[c][w] - 1, 0) + kinds[c] * both[w] / sum(both.values())) / totals[c]
    given = lambda c, h, w: (max(n[c][h, w] - 1, 0) + after[c][h] * lower(c, w)) / h_n[c][h] if h_n[c][h] else lower(c, w)

    def e(h, w):
        own = 0.0
        if max(before[0][w], before[1][w]) > 1:
            own = s([before[c][w] for c in (0, 1)], totals) * (math.log(lower(1, w) / lower(0, w)) - math.log(kinds[1] / totals[1]) + math.log(kinds[0] / totals[0]))
        if max(n[0][h, w], n[1][h, w]) < 2:
            return own
        sure = s([n[c][h, w] for c in (0, 1)], pairs)
        return sure * math.log(given(1, h, w) / given(0, h, w)) + (1 - sure) * own

    return lambda text: [e(h, w) for words in [rx.findall(text.translate(LOWER))] for h, w in zip([None, *words], words)]


@pytest.mark.parametrize(("blob_bytes", "broadcast_rows"), [(1, 10**6), (1 << 30, 10**6), (1, 0)])
def test_evidence_equals_a_plain_model(spark, blob_bytes, broadcast_rows):
    rng = random.Random(5)
    rows = [(f"{prose(rng, 40)}{' you Clown' if k % 5 == 0 else ' kind friend'}, {prose(rng, rng.randrange(30))}", int(k % 5 == 0)) for k in range(200)]
    rows += [("", 1), ("x", 0), rows[0], rows[3], ("a clown " * 30, 1)]
    distinct = toxicity.distinct_texts(spark.createDataFrame(rows, "text string, toxic int"), broadcast_rows)
    model = toxicity.likelihood_ratios(distinct, 15.0, 4000, 1 << 20, blob_bytes)
    texts = [t for t, _ in rows[::7]] + ["", "Clown", "you you you clown", "unknown words only here and there and everywhere", prose(rng, 500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r["id"]: (r["mean_ratio"], r["span_ratio"]) for r in toxicity.text_ratios(docs, model, 8, broadcast_rows, 700)[0].collect()}
    evidence = plain_evidence(rows)
    for k, text in enumerate(texts):
        e = evidence(text)
        mean = sum(e) / max(1, len(e))
        spans = [sum(e[j : j + 8]) / 8 for j in range(len(e) - 7)] or [mean]
        assert abs(got[k][0] - mean) < 1e-6 and abs(got[k][1] - max(spans)) < 1e-6


def test_contexts_are_counted_beyond_sixteen_bits(spark):
    texts = [" ".join(f"c{k} word" for k in range(a, a + 10_000)) for a in range(0, 80_000, 10_000)]
    rows = spark.createDataFrame([(t, k % 2) for k, t in enumerate(texts)], "text string, toxic int")
    _, words = toxicity.pair_counts(rows, 1 << 20, 1 << 20, 1)
    top = words.orderBy(F.desc("before")).first()
    assert (top["before"], top["before_t"], top["before_o"]) == (80_000, 40_000, 40_000)


def test_scores_do_not_depend_on_the_way(spark, small):
    docs, _, labels = small
    one = toxicity.toxicity(docs, labels).select("doc_id", "score")
    many = toxicity.toxicity(docs, labels, broadcast_rows=0, broadcast_labels=0, blob_bytes=1 << 30).select("doc_id", "score")
    assert {(r[0], round(r[1], 6)) for r in one.collect()} == {(r[0], round(r[1], 6)) for r in many.collect()}


def test_a_large_model_is_dealt_out_in_rounds(spark, small, monkeypatch):
    """Nothing gathers a chunk's expressions row by row, which took executors' memory on a few GB; each row is in one round."""
    docs, _, labels = small
    written, write = [], toxicity.materialize
    monkeypatch.setattr(toxicity, "materialize", lambda df, name="t": written.append((name, df._jdf.queryExecution().toString())) or write(df, name))
    one = toxicity.toxicity(docs, labels).select("doc_id", "mean_ratio", "span_ratio").collect()
    toxicity.toxicity(docs, labels, broadcast_rows=0)
    assert not any("collect_list" in plan for _, plan in written)
    many = toxicity.toxicity(docs, labels, broadcast_rows=0, slice_bytes=1 << 17, bucket_bytes=1 << 18, round_bytes=1, rounds=3)
    assert sorted(map(tuple, one)) == sorted(map(tuple, many.select("doc_id", "mean_ratio", "span_ratio").collect()))
    assert [name for name, _ in written].count("round") == 4
