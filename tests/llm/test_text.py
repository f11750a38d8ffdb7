"""Packing, media, toxicity, near duplicates, line duplicates, the pipeline."""

import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from made_up import prose
from pyspark.sql import functions as F

from quillspark.llm import embed_dedup as E
from quillspark.llm import line_dedup as L
from quillspark.llm import media as M
from quillspark.llm import minhash as H
from quillspark.llm import packing as P
from quillspark.llm.common import connected_groups, link_buckets, met_before
from quillspark.llm.embed_dedup import near_vectors
from quillspark.llm.line_dedup import dedup_lines
from quillspark.llm.toxicity import fit_isotonic, fit_toxicity, fit_trees, learn_lexicon, op6_toxicity, score_toxicity

# --- packing ---


def packed_well(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_ids_are_those_of_the_tokenizer(spark, odd_documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "  a b", "a \n b", "x  y\t z ", "don't 12 ab!! <|endoftext|> q", "<|endoftext|>", "a<|endoftext|><|endoftext|> \n  b", "<|endoftext",  "\n\n a", "a\n\n b", "é ñ x y", "a\x1c b", *(r["text"] or "" for r in odd_documents.collect())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = defaultdict(list)
    for r in P.token_pieces(df, with_ids=True).orderBy("doc_id", "piece").collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == len(got[r["doc_id"]]) and r["length"] == len(ids) <= 2048 and r["ids_crc32"] == crc32(r["ids"])
        assert r["piece"] == 0 or r["length"] == 2048
        got[r["doc_id"]] += ids
    for i, t in enumerate(texts):
        assert got[i] == tok.encode(t, add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_length_once(seed):
    r = random.Random(seed)
    lengths = [min(2048, max(1, int(r.lognormvariate(5 + seed % 3, 1.2)))) for _ in range(3000)] if seed else [700] * 301 + [600] * 300 + [45] * 10
    count = Counter(lengths)
    made, plan = P.plan_packing(dict(count))
    rows, seen = [], defaultdict(set)
    for length, a, b, first, offset in plan:
        for k in range(a, b):
            assert k not in seen[length]
            seen[length].add(k)
            rows.append({"sequence_id": first + k - a, "offset": offset, "length": length})
    assert {n: len(s) for n, s in seen.items()} == count
    # of 700s and 600s no four fit together, so 601 of them need 201 sequences whatever their sum
    assert packed_well(rows, 2048) == made <= (1.02 * -(-sum(lengths) // 2048) + 1 if seed else 201)


def test_odd_packing(odd_documents, no_documents):
    got = P.pack_documents(odd_documents).collect()
    packed_well(got, 2048)
    assert sum(r["piece"] == 0 for r in got) == odd_documents.count() and P.pack_documents(no_documents).count() == 0


def test_registered_packing_against_the_tokenizer(spark, odd_documents, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    odd_documents.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, sizes = Counter(), []
    for r in odd_documents.collect():
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        starts = [0, *range(first, len(ids), 2048)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[r["doc_id"], k, a, b - a, crc32(ids[a:b].tobytes())] += 1
            sizes.append(b - a)
    got = P.op4_best_fit_packing(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert packed_well(got, 2048) == -(-sum(sizes) // 2048)


# --- media ---


@pytest.mark.parametrize("size", [0, 1, 64, 65, 1000, 64 * 6 * 5])
def test_media_round_trip(size):
    payload = M.padded(None)[1] if not size else bytes(np.random.default_rng(size).integers(0, 256, -(-size // 64) * 64, dtype=np.uint8))
    file = M.encode(payload)
    quick, slow = M.read_coefficients(file), M.read_coefficients(file, quick=False)
    assert M.payload_of(quick) == M.payload_of(slow) == payload
    assert (M.rgb_of(quick) == M.rgb_of(slow)).all()


def test_scans_with_zero_runs_end_of_band_runs_and_new_coefficients():
    """A grey image of two blocks by hand: AC first with a run and an end-of-band run, then a refinement."""
    bits = lambda s: M._stuffed(np.array([int(c) for c in s.replace(" ", "")], np.uint8))
    scan = lambda first, last, a, data: M._segment(0xDA, bytes([1, 1, 0, first, last, a])) + data
    head = b"\xff\xd8" + M._segment(0xDB, b"\0" + b"\1" * 64) + M._segment(0xC2, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    head += M._huffman(0, 0, [2, 0]) + M._huffman(1, 0, [0x21, 0x10, 0x01, 0x00])
    file = head + scan(0, 0, 0x00, bits("0 11  10"))  # DC 3 and 3
    file += scan(1, 63, 0x01, bits("0 1  10 0"))  # AC 3 is 1 << 1, then an end-of-band run over both blocks (1 bit: 2)
    # refinement: block 0 skips none, a new -1 at 1 (code 110), its end with the correction of AC 3; block 1 ends
    file += scan(1, 63, 0x10, bits("110 0  1110 1  1110")) + b"\xff\xd9"
    coefs = M.read_coefficients(file)["parts"][1]["coefs"]
    assert coefs[0, :5].tolist() == [3, -1, 0, 3, 0] and coefs[1, :5].tolist() == [3, 0, 0, 0, 0]


def test_inverse_transform_against_floats():
    x = np.random.default_rng(1).integers(-255, 256, (5, 64))
    u = np.arange(8)
    c = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    blocks = np.zeros((5, 64))
    blocks[:, M._zigzag()] = x
    want = np.einsum("yv,xu,nvu->nyx", c, c, blocks.reshape(5, 8, 8))
    assert np.abs((x @ M.BASIS) / (1 << M.SCALE) - want.reshape(5, 64)).max() < 6


def test_odd_media(odd_documents, no_documents):
    stored = M.store_media(odd_documents).withColumn("t", M.to_tensor("media"))
    for r in stored.select("text", "media", "t").collect():
        n, payload = M.padded(r["text"])
        assert M.payload_of(M.read_coefficients(r["media"])) == payload
        assert len(r["t"]["rgb"]) == 3 * r["t"]["height"] * r["t"]["width"]
    assert M.store_media(no_documents).count() == 0 and M.tensors(no_documents).count() == 0


# --- toxicity ---


def test_registered_media_against_the_bytes(spark, odd_documents, tmp_path):
    from hashlib import sha256

    odd_documents.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    rows = M.op8_media_columns(spark, str(tmp_path)).collect()
    want = Counter()
    for r in odd_documents.collect():
        b = (r["text"] or "").encode()
        p = b + b"\0" * (-len(b) % 64 or (0 if b else 64))
        want[r["doc_id"], len(b), len(p), sha256(p).hexdigest(), crc32(p[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    for r in rows:
        jpeg = M.encode(M.padded(next(o["text"] for o in odd_documents.collect() if o["doc_id"] == r["doc_id"] and len((o["text"] or "").encode()) == r["n_bytes"]))[1])
        rgb = M.rgb_of(M.read_coefficients(jpeg))
        assert (r["media_bytes"], r["height"], r["width"], r["rgb"]) == (len(jpeg), *rgb.shape[:2], rgb.tobytes())


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0)).astype(float)
    raw = fit_trees(x[:2000], y[:2000]).raw(x[2000:])
    assert ((raw > 0) == y[2000:]).mean() > 0.95
    knots, values = fit_isotonic(raw, y[2000:])
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all()


def test_toxic_texts_are_found(spark, odd_documents, no_documents):
    r = random.Random(3)
    rows = [(i, prose(i, 40) + (" you utter nincompoop vilea" + "xyz"[i % 3] + " scoundrel" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(500)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    model = fit_toxicity(df.select("doc_id", "text"), df.where("doc_id < 350").select("doc_id", "toxic"))
    got = score_toxicity(df, model).where("doc_id >= 350").collect()
    assert all((x["score"] >= 0.3) == bool(x["toxic"]) for x in got)
    odd = score_toxicity(odd_documents, model, score="score").collect()
    assert len(odd) == odd_documents.count() and all(0 <= x["score"] <= 1 for x in odd)
    assert score_toxicity(no_documents, model).count() == 0
    empty = fit_toxicity(no_documents, df.select("doc_id", "toxic").where("false"))
    assert score_toxicity(odd_documents, empty).where("score <> 0").count() == 0


def test_more_tasks_than_labelled_rows(spark):
    rows = [(i, prose(i, 40) + (" you utter nincompoop" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, text string, toxic int").repartition(200, "doc_id")
    model = fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = score_toxicity(df, model).collect()
    assert all((x["score"] >= 0.3) == bool(x["toxic"]) for x in got)
    assert learn_lexicon(df.where("toxic = 1").repartition(50).select("text", F.col("toxic").alias("label"))) == {}


def test_registered_toxicity(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, prose(i, 30) + (f" you {r.choice(('utter', 'vile'))} nincompoop scoundrel" if i % 4 == 0 else "") if i % 50 else None) for i in range(800)]
    labels = [(i, 0, int(i % 4 == 0 and bool(i % 50))) for i in range(800)]
    for name, flip in (("one", False), ("two", True)):
        d = tmp_path / name
        spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(d / "documents.parquet"))
        held = [(i, q, 1 - y if flip and crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels]
        spark.createDataFrame(held, "doc_id bigint, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    got = {x["doc_id"]: x for x in op6_toxicity(spark, str(tmp_path / "one")).collect()}
    assert len(got) == 800 and all(x["held_out"] == (crc32(str(i).encode()) % 4 == 2) and x["predicted"] == int(x["score"] >= 0.3) and 0 <= x["score"] <= 1 for i, x in got.items())
    own = [i for i, x in got.items() if x["held_out"]]
    assert sum(got[i]["predicted"] == labels[i][2] for i in own) >= 0.98 * len(own)
    # labels that are held out change nothing
    assert {x["doc_id"]: x for x in op6_toxicity(spark, str(tmp_path / "two")).collect()} == got


# --- groups ---


def union_find(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("chunk", [2_000_000, 40])
def test_connected_groups(spark, chunk):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(7, 7)]
    got = {x["id"]: x["root"] for x in connected_groups(spark.createDataFrame(edges, "a bigint, b bigint"), chunk).collect()}
    want = union_find(edges, {i for e in edges if e[0] != e[1] for i in e})
    assert got == want
    assert connected_groups(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_buckets_link_all_that_brute_force_links(spark):
    r = random.Random(5)
    place = {i: r.random() for i in range(120)}
    buckets = {(b, r.randrange(120)) for b in range(12) for _ in range(25)}
    near = lambda a, b: abs(place[a] - place[b]) < 0.02
    members = defaultdict(list)
    for b, i in buckets:
        members[b].append(i)
    want = union_find([(a, b) for m in members.values() for a in m for b in m if a < b and near(a, b)], place)
    verify = lambda p, _: spark.createDataFrame([(x["a"], x["b"]) for x in p.collect() if near(x["a"], x["b"])], "a bigint, b bigint")
    said = lambda ids: ids.join(spark.createDataFrame(list(place.items()), "id bigint, x double"), "id")

    def compare(columns, asks, asked, may):
        at = [(int(columns["id"][k]), columns["x"][k]) for k in range(len(columns["id"]))]
        return [(at[p][0], at[q][0]) for n, p in enumerate(asks) for k, q in enumerate(asked) if may[n, k] and abs(at[p][1] - at[q][1]) < 0.02]

    # with few members a block, buckets fall into many blocks; without a round, blocks do all the work
    for rounds, block in ((3, 256), (1, 4), (0, 3)):
        links = link_buckets(spark.createDataFrame(sorted(buckets), "b bigint, id bigint"), verify, compare, said, rounds, block)
        assert union_find([tuple(x) for x in links.collect()], place) == want


def test_pairs_met_in_an_earlier_bucket():
    r = random.Random(6)
    own = [sorted(r.sample(range(-20, 20), r.randrange(1, 9))) for _ in range(40)]
    ends, bands = np.cumsum([0, *map(len, own)]).astype(np.int32), np.concatenate(own).astype(np.int64)
    asks, asked = np.arange(0, 40, 3), np.arange(5, 40)
    for bucket in (-20, -3, 4, 19):
        got = met_before(ends, bands, asks, asked, bucket)
        assert got.tolist() == [[any(x < bucket and x in own[b] for x in own[a]) for b in asked] for a in asks]


# --- near-duplicate documents ---


def test_documents_of_a_block_link_once_a_group(monkeypatch):
    r = random.Random(7)
    start = [r.choice("abcdefgh") + r.choice("aeiou") for _ in range(120)]
    texts = [" ".join(r.choice("xyz") if r.random() < 0.01 * (k % 8) else w for w in start) for k in range(60)] + ["a " * 30, "a " * 33, "", None]
    bags = [dict(zip(*(x.tolist() for x in np.unique(H.shingles(t), return_counts=True)))) for t in texts]
    share = [[sum(min(n, b.get(k, 0)) for k, n in a.items()) for b in bags] for a in bags]
    like = lambda a, b: share[a][b] > 0 and share[a][b] >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - share[a][b])
    asks, asked, root = np.arange(20, 64), np.arange(50), np.arange(64) // 5
    may = root[asks][:, None] != root[asked]
    want = {(a, root[b]) for a in asks for b in asked if root[a] != root[b] and like(a, b)}
    for dense, pairs, letters in ((H.DENSE, H.PAIRS, H.LETTERS), (1, 50, H.LETTERS), (10**9, 50, H.LETTERS), (4, 1, 5000)):
        monkeypatch.setattr(H, "DENSE", dense)
        monkeypatch.setattr(H, "PAIRS", pairs)
        monkeypatch.setattr(H, "LETTERS", letters)
        got = H.comparing()({"id": np.arange(64), "root": root, "text": texts}, asks, asked, may)
        assert all(like(a, b) and root[a] != root[b] for a, b in got)
        assert {(a, root[b]) for a, b in got} == want and (letters < 10**6 or len(got) == len(want) > 100)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    keys = H._mix(np.arange(1, 301, dtype=np.uint64))
    one, two = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
    two[:150] = one[:150]
    agree = []
    for k in range(40):
        key = H._mix(keys + np.uint64(k * 1000))
        pair = [H.signatures(np.zeros((w > 0).sum(), np.int64), key[w > 0], w[w > 0].astype(float), 1, 128)[0] for w in (one, two)]
        agree.append((pair[0] == pair[1]).mean())
    true = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    assert abs(np.mean(agree) - true) < 4 * np.sqrt(true * (1 - true) / (40 * 128))


def brute(texts):
    bags = {i: Counter(H.shingles(t).tolist()) for i, t in texts.items()}
    pairs = []
    for a in bags:
        for b in bags:
            if a < b and bags[a] and bags[b]:
                m = sum((bags[a] & bags[b]).values())
                if m / (sum(bags[a].values()) + sum(bags[b].values()) - m) >= 0.8:
                    pairs.append((a, b))
    return union_find(pairs, bags)


def near_copies():
    r, texts = random.Random(2), {}
    for base in range(12):
        words = prose(100 + base, 120).split()
        for k in range(1 + base):
            own = list(words)
            for _ in range(r.randrange(6)):
                own[r.randrange(len(own))] = f"new{r.randrange(1000)}"
            texts[len(texts) * 3 + 1] = " ".join(own) + ("!" if k % 4 == 3 else "")
    return texts


def test_near_duplicates_against_brute_force(spark):
    texts = near_copies()
    got = H.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == brute(texts)
    kept = H.keep_one_of_each(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {x["doc_id"] for x in kept} == set(brute(texts).values())


def test_registered_near_duplicates_against_brute_force(spark, tmp_path):
    texts = near_copies() | {100_000: "", 100_001: None, 100_002: "too short", 100_003: "too short"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = H.op9_minhash_near_dedup(spark, str(tmp_path)).collect()
    want = brute({i: t or "" for i, t in texts.items()})
    assert {r["doc_id"]: r["component_id"] for r in got} == want and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_near_duplicates(odd_documents, no_documents):
    got = H.near_duplicates(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by_id = {x["doc_id"]: x["component_id"] for x in got if x["doc_id"] is not None}
    assert by_id == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 6, 7: 7, 8: 8, 9: 4}
    assert all(x["component_id"] is None for x in got if x["doc_id"] is None)
    kept = H.keep_one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns and sorted((x["doc_id"] or 0) for x in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 8]
    assert H.near_duplicates(no_documents).count() == 0 and H.keep_one_of_each(no_documents).count() == 0


# --- vectors ---


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 16))
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, 16)) * 0.05, np.repeat(base[:1], 50, 0) + rng.normal(size=(50, 16)) * 0.03]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, x[7].tolist()), (1000, x[7].tolist())]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [float("inf")] + [0.0] * 15), (None, x[0].tolist()), (2005, [1.0, 2.0]), (2006, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id bigint, embedding array<float>, n int")
    got = near_vectors(df).collect()
    assert len(got) == len(rows) + len(odd)
    ids = [i for i, _ in rows[:-1]]
    y = np.array([v for _, v in rows[:-1]], float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    link = y @ y.T >= 0.95
    np.fill_diagonal(link, False)
    links = dict(zip(ids, link.sum(1)))
    roots = union_find([(ids[a], ids[b]) for a, b in zip(*np.nonzero(link)) if a < b], ids)
    for r in got:
        if r["vec_id"] in links:
            assert (r["n_links"], r["component_id"]) == (links[r["vec_id"]], roots[r["vec_id"]])
        else:
            assert r["n_links"] == 0 and r["component_id"] == r["vec_id"]
    assert near_vectors(df.where("false")).count() == 0


def clustered(n, dim, seed):
    """Vectors in many clusters of copies and near copies, chains and a dense one."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    near = base[rng.integers(0, len(base), n // 2)] + rng.normal(size=(n // 2, dim)) * rng.uniform(0.02, 0.3, (n // 2, 1))
    dense = base[0] + rng.normal(size=(n - n // 4 - n // 2, dim)) * 0.12
    return np.concatenate([base, near, dense])


def exact_links(x, limit=0.95):
    y = x / np.linalg.norm(x, axis=1)[:, None]
    link = y @ y.T >= limit
    np.fill_diagonal(link, False)
    return link


def test_graph_search_finds_what_brute_force_finds():
    x = E.unit(list(clustered(1500, 24, 1)))
    nbr = E.robust_prune(x)
    assert (nbr != np.arange(len(x))[:, None]).all() and (nbr >= 0).any(1).all()
    a, b = E.range_search(x, E._united([r[r >= 0] for r in nbr], np.arange(len(x))), 0.95)
    want = exact_links(x)
    assert want[a, b].all() and len(a) >= 0.98 * want.sum() > 1000 and {*zip(b.tolist(), a.tolist())} == {*zip(a.tolist(), b.tolist())}
    c, d = E.all_in_range(x, 0.95)
    assert len(c) == want.sum() and want[c, d].all()
    for few in (x[:1], x[:2], np.repeat(x[:1], 3, 0)):
        E.range_search(few, E._united([r[r >= 0] for r in E.robust_prune(few)], np.arange(len(few))), 0.95)


def test_vectors_over_many_clusters_and_blocks(spark, tmp_path, monkeypatch):
    for k, v in {"SHARD_ROWS": 150, "BLOCK_ROWS": 120, "CLUSTERS": 4, "RESIDUALS": 3}.items():
        monkeypatch.setattr(E, k, v)
    x = clustered(1600, 16, 2).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(E.op2_embedding_near_dedup(spark, str(tmp_path)).collect())
    want = exact_links(x.astype(float))
    roots = union_find(list(zip(*np.nonzero(np.triu(want)))), range(len(x)))
    assert got[0]["audit_recall"] >= 0.98 and sum(r["n_links"] for r in got) >= 0.98 * want.sum() and all(r["n_links"] <= want[r["vec_id"]].sum() for r in got)
    assert sum(r["component_id"] == roots[r["vec_id"]] for r in got) >= 0.98 * len(got) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_vectors_are_all_compared_if_audits_fall_short(spark, monkeypatch):
    monkeypatch.setattr(E, "range_search", lambda x, adjacency, limit, seed=0: (np.zeros(0, int), np.zeros(0, int)))
    monkeypatch.setattr(E, "BLOCK_ROWS", 100)
    x = clustered(400, 16, 3)
    got = near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"), overlaps=(3,)).collect()
    links = exact_links(x).sum(1)
    assert all(r["n_links"] == links[r["vec_id"]] and r["audit_recall"] == 1.0 for r in got)


def test_an_id_with_two_vectors_and_a_table_without_links(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0]), (3, [-1.0, 0.0])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]
    alone = near_vectors(spark.createDataFrame(rows[:1] + rows[3:], "vec_id bigint, embedding array<double>")).collect()
    assert all(r["n_links"] == 0 and r["audit_recall"] is None for r in alone)


# --- lines ---


def normal(lines):
    import pyarrow as pa

    return [t for _, some, _ in L.digest_lines(pa.array(lines)) for t in some.strings()]


def keys_of(lines):
    import pyarrow as pa

    out = []
    for _, some, hashes in L.digest_lines(pa.array(lines)):
        _, keys, has = L.blocks(hashes, some.ends - some.starts, some.counts)
        out += [set(k[h].tolist()) for k, h in zip(keys, has)]
    return out


def test_normal_words():
    lines = ["", "  ", "Ab, c-D\t9 12", "ÉA\u00a0b\u2014c\u2026 «d»", "x\u3000y\u3001z", "!?", "\u00ad", "ñ", "don't"]
    assert normal(lines) == ["", "", "ab c d 0 00", "éa b c d", "x y z", "", "", "ñ", "don t"]
    assert normal([]) == [] and normal(["a" * 700_000, "b", "c" * 700_000]) == ["a" * 700_000, "b", "c" * 700_000]


def test_bit_counts_of_long_lines():
    rng = np.random.default_rng(0)
    counts = np.array([0, 3, 255, 256, 700, 1, 0])
    words = rng.integers(0, 1 << 63, counts.sum(), dtype=np.int64).astype(np.uint64) * np.uint64(2)
    line = np.repeat(np.arange(len(counts)), counts)
    got = L.bit_counts(words, line, len(counts))
    for k in range(len(counts)):
        assert got[k].tolist() == [int((words[line == k] >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]


def test_one_word_leaves_blocks_as_they_were():
    rng = random.Random(4)
    lines = [prose(k, n) for k, n in enumerate([10, 15, 25, 35, 43, 45, 60, 120] * 25)]
    changed = []
    for line in lines:
        said = line.split()
        said[rng.randrange(len(said))] = "otherword"
        changed.append(" ".join(said))
    met = [bool(a & b) for a, b in zip(keys_of(lines), keys_of(changed))]
    assert sum(met) >= 0.98 * len(met)


def test_line_hashes_tell_words_and_their_order():
    lines = ["a b", "b a", "ab", "a b a b", "A, b", "a  B!", "", "b", "a"] + [prose(k, 30) for k in range(50)]
    import pyarrow as pa

    (_, some, hashes), = L.digest_lines(pa.array(lines))
    h, g = L.line_hashes(hashes, some.counts)
    assert len(set(h.tolist())) == len(set(g.tolist())) == len(set(normal(lines)))
    assert h[0] == h[4] == h[5] and g[0] == g[4] == g[5]


def test_edit_distance():
    r = random.Random(2)
    for _ in range(400):
        x, y = ("".join(r.choice("abc") for _ in range(r.randrange(12))) for _ in range(2))
        assert L.edit_distance(x, y) == slow_distance(x, y)
        for most in range(12):
            assert L.within(x, y, most) == L.within(x + " a b", y + " a b", most) == (slow_distance(x, y) <= most)
    x = prose(3, 80)
    assert L.edit_distance(x, x[:50] + "zz" + x[60:]) == slow_distance(x, x[:50] + "zz" + x[60:])


def test_pairs_that_a_common_text_rules_out_are_apart():
    r = random.Random(6)
    base = prose(77, 30)
    texts = []
    for k in range(40):
        said = base.split()
        for _ in range(r.randrange(12)):
            said[r.randrange(len(said))] = f"w{r.randrange(10**6)}"
        texts.append(" ".join(said))
    one, two = texts[:15], texts[15:]
    sims = np.arange(len(two), dtype=np.uint64)
    may = L.may_be_within(one, two, sims, np.ones((15, 25), bool), 0.9)
    close = np.array([[L.edit_distance(x, y) <= int(0.1 * max(len(x), len(y)) + 1e-9) for y in two] for x in one])
    assert (may | ~close).all() and (~may).sum() > 30 and L.may_be_within(one, two, sims, np.zeros((15, 25), bool), 0.9).all()


def slow_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row = row, [i]
        for j, b in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
    return row[-1]


def test_lines_keep_one_occurrence(spark):
    line, other = prose(50, 60), prose(51, 60)
    near = line.replace(line.split()[10], "changed", 1)
    texts = {3: f"{line}\nshort one\n{other}", 1: f"first own {prose(52, 20)}\n{line.upper()}!\nShort: one", 2: f"{near}\n{prose(53, 30)}\n--\n", 4: other, 5: "--\n"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in dedup_lines(df).collect()}
    assert got[1]["removed_lines"] == [] and got[3]["text"] == other and got[4]["text"] == "" and got[2]["removed_lines"] == [0] and got[5]["text"] == "--\n"


def line_corpus():
    """Lines of all lengths with respelt copies, ties at the bound, chains, and one large group."""
    rng = random.Random(5)
    lines = [prose(100 + k, rng.choice((6, 8, 12, 20, 30, 50))) for k in range(60)]
    copies = []
    for line in lines:
        said = line.split()
        for k in rng.sample(range(len(said)), max(1, len(said) // 20)):
            said[k] = said[k][:-1] + "zq"
        copies.append(" ".join(said))
    for k in range(120):  # copies of one line
        said = lines[5].split() if len(lines[5].split()) > 15 else prose(999, 40).split()
        said[rng.randrange(len(said))] = f"own{k}"
        copies.append(" ".join(said))
    for edits in (10, 11):  # just at the bound of a tenth, and beyond
        line = prose(300 + edits, 20)[:100].ljust(100, "x")
        copies += [line, line[:40] + "q" * edits + line[40 + edits :]]
    return lines + copies


def test_lines_against_brute_force(spark):
    lines = line_corpus()
    said = normal(lines)
    alike = [(a, b) for a in range(len(said)) for b in range(a) if abs(len(said[a]) - len(said[b])) <= 0.1 * max(len(said[a]), len(said[b])) and L.edit_distance(said[a], said[b]) <= int(0.1 * max(len(said[a]), len(said[b])) + 1e-9)]
    want = union_find(alike, range(len(said)))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r["doc_id"] for r in dedup_lines(df).collect() if r["removed_lines"]}
    first = {k for k in want if want[k] != k}
    assert gone <= first and len(gone) >= 0.97 * len(first) > 150


def test_blocks_alone_find_what_rounds_find(spark, monkeypatch):
    lines, texts = spark.createDataFrame(list(enumerate(line_corpus())), "doc_id long, text string"), near_copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = {r["doc_id"] for r in dedup_lines(lines).collect() if r["removed_lines"]}
    for module in (L, H):
        monkeypatch.setattr(module, "link_buckets", lambda *a, rounds=0, f=link_buckets: f(*a, rounds=0))
    assert {r["doc_id"] for r in dedup_lines(lines).collect() if r["removed_lines"]} == want
    assert {r["doc_id"]: r["component_id"] for r in H.near_duplicates(docs).collect()} == brute(texts)


def test_many_edit_distances_at_once(monkeypatch):
    r = random.Random(9)
    for letters in ("ab", "abcdefgh ", "aäß漢字🙂x"):
        texts = []
        for n in (0, 1, 5, 63, 64, 130, 330, 660):
            start = [r.choice(letters) for _ in range(n)]
            for _ in range(5):
                t = list(start)
                for _ in range(r.randrange(max(n // 7, 1) + 1)):
                    k = r.randrange(len(t) + 1)
                    t[k : k + r.randrange(2)] = [r.choice(letters)] * r.randrange(2)
                texts.append(" ".join("".join(t).split()))  # as lines are normalised
        a, b = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
        far = np.array([L.edit_distance(texts[i], texts[j]) for i, j in zip(a, b)])
        for few, size, pairs in ((0, L.TABLE_BYTES, L.PAIRS), (0, 4000, 7), (10**6, L.TABLE_BYTES, L.PAIRS)):
            for name, value in (("FEW", few), ("TABLE_BYTES", size), ("PAIRS", pairs)):
                monkeypatch.setattr(L, name, value)
            for most in (np.maximum(far + np.array([r.randrange(-2, 3) for _ in far]), 0), np.array([L.most_edits(len(texts[i]), len(texts[j]), 0.9) for i, j in zip(a, b)])):
                assert (L.all_within(texts, a, b, most) == (far <= most)).all()
    assert L.all_within(["a"], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_registered_lines_against_brute_force(spark, tmp_path):
    df = spark.createDataFrame([(k, "\n".join(line_corpus()[k : k + 1] + ["own " + prose(5000 + k, 8)])) for k in range(len(line_corpus()))], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = L.op7_line_dedup(spark, str(tmp_path)).collect()
    said = {r["doc_id"]: t for r, t in zip(got, normal([line_corpus()[r["doc_id"]] for r in got]))}
    close = lambda a, b: L.edit_distance(said[a], said[b]) <= int(0.1 * max(len(said[a]), len(said[b])) + 1e-9)
    want = union_find([(a, b) for a in said for b in said if b < a and abs(len(said[a]) - len(said[b])) <= 0.1 * max(len(said[a]), len(said[b])) and close(a, b)], said)
    gone = {r["doc_id"] for r in got if 0 in r["removed_lines"]}
    assert gone <= {k for k in want if want[k] != k} and len(gone) >= 0.97 * sum(k != v for k, v in want.items())
    assert all(r["n_lines"] == 2 and 1 not in r["removed_lines"] for r in got)


def test_odd_lines(odd_documents, no_documents):
    got = dedup_lines(odd_documents)
    assert got.count() == odd_documents.count() and dedup_lines(no_documents).count() == 0
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[3]["text"] is None and by[2]["text"] == "" and by[9]["text"] == "" and by[5]["text"] == "" and by[8]["text"] == prose(5, 60)
    assert by[7]["text"].startswith("one line\n\n") and sum(r["doc_id"] == 1 and r["text"] != "" for r in got.collect()) == 2


# --- pipeline ---


def test_pipeline_over_odd_documents(spark, odd_documents, no_documents, tmp_path):
    import corpus_pipeline as C

    spark.createDataFrame([(1, 0), (7, 1), (None, 1), (8, None)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd_documents, no_documents):
        out = docs
        for name, stage in C.STAGES:
            out = stage(spark, out, str(tmp_path))
            if name != "packing":
                assert out.columns == list(C.COLUMNS), name
        packed_well(out.collect(), 2048)
    kept = C.drop_near_duplicates(spark, C.drop_repeated_lines(spark, odd_documents, ""), "")
    assert {r["doc_id"] for r in kept.collect()} == {None, 1, 2, 3, 4, 6, 7, 8}
    odd_documents.select(*C.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() > 0
    assert kept.where(F.col("n_chars").isNull()).count() == 2


def test_pipeline_against_its_stages_and_brute_force(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(8)
    texts = {i: [prose(7000 + 3 * i + k, rng.choice((8, 25, 60))) for k in range(3)] for i in range(60)}
    for i in range(60, 90):  # near copies, of which the lines that differ by a letter go first
        texts[i] = [t if rng.random() < 0.5 else t[:20] + "qq" + t[20:] for t in texts[i - 60]]
    for i in range(90, 130):
        texts[i] = [*texts[i - 90][:1], prose(9000 + i, 30), "you utter nincompoop vileax scoundrel " * 2]
    rows = [(i, "\n".join(t), "en", f"s{i % 3}", 1) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i >= 90)) for i in texts], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, d = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    mild = C.drop_toxic(spark, docs, d).cache()
    kept = {r["doc_id"]: r["text"] for r in mild.collect()}
    assert set(kept) == set(range(90))
    places = [(i, no) for i in sorted(kept) for no in range(3)]
    said = dict(zip(places, normal([kept[i].split("\n")[no] for i, no in places])))
    number = {p: k for k, p in enumerate(places)}

    def alike(p, q):
        most = int(0.1 * max(len(said[p]), len(said[q])) + 1e-9)
        return abs(len(said[p]) - len(said[q])) <= most and L.edit_distance(said[p], said[q]) <= most

    first = union_find([(number[p], number[q]) for p in places for q in places if q < p and alike(p, q)], range(len(places)))
    left = {i: "\n".join(kept[i].split("\n")[no] for no in range(3) if first[number[i, no]] == number[i, no]) for i in kept}
    lines = C.drop_repeated_lines(spark, mild, d).cache()
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {i: t for i, t in left.items() if t}
    own = C.drop_near_duplicates(spark, lines, d).cache()
    assert {r["doc_id"] for r in own.collect()} == set(brute({i: t for i, t in left.items() if t}).values())
    # copies of a document are equal, so which of them has which place is open
    want = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in C.pack(spark, C.mix(spark, own, d), d).collect())
    got = C.run(spark, d).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want and packed_well(got, 2048)
