import random

import corpus_pipeline
from test_contamination import change, edits
from test_jaccard import components
from test_mixing import fill_targets
from test_substrings import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    junk = lambda n: " ".join(rng.choice(["!!", "###", "buy", "now", "xxx"]) for _ in range(n))
    passage, items = prose(90), [prose(25) for _ in range(4)]
    texts = [prose(rng.randint(20, 150)) for _ in range(60)] + [junk(60) for _ in range(20)]
    texts += [texts[k] for k in range(5)] + [change(rng, texts[k], 2) for k in range(5, 10)]
    texts += [prose(40) + " " + passage + " " + prose(40) for _ in range(3)] + [prose(60) + " " + items[k] + " " + prose(60) for k in range(3)] + [prose(60) + " " + change(rng, items[3], 3), None, ""]
    rows = [(k, t, "en", f"s{k % 4}", None if t is None else len(t)) for k, t in enumerate(texts)]
    where = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(k, int(not 60 <= k < 80), 0) for k in range(80) if k % 2], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    now, docs = {r[0]: r for r in rows}, spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, where)
        out.write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        got = docs.collect()
        if name == "mix":
            break
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = {r["doc_id"]: tuple(r) for r in got}
        assert len(kept) == len(got)
        if name == "quality":
            assert set(kept) == {k for k in now if not 60 <= k < 80}
        elif name == "near_duplicates":
            found = components([(k, now[k][1]) for k in sorted(now)])
            assert set(kept) == {d for d, n, c in found if not n or d == c} and len(kept) < len(now)
        elif name == "repeats":
            want = {k: b for k, b in zip(now, brute([(now[k][1] or "").encode() for k in now], 400))}
            for k, (left, _, gone) in want.items():
                if not gone:
                    assert kept[k] == now[k]
                elif left:
                    assert abs(len(kept[k][1].encode()) - len(left)) <= 6 and kept[k][4] == len(kept[k][1])
            assert sum(g > 0 for _, _, g in want.values()) == 3
        elif name == "benchmark":
            clean = {k for k in now if not any(edits(i, now[k][1] or "") <= int(len(i) * 0.08) for i in items)}
            assert set(kept) == clean and len(clean) == len(now) - 4
        now = kept if name == "quality" else {r["doc_id"]: tuple(r) for r in got}
    size = {}
    for k in now:
        size[now[k][3]] = size.get(now[k][3], 0) + len((now[k][1] or "").split())
    names = sorted(size)
    want = dict(zip(names, fill_targets([float(size[n]) for n in names], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(names))])))
    taken = {n: 0 for n in names}
    for r in got:
        assert tuple(r)[:5] == now[r["doc_id"]]
        taken[r["source"]] += len((r["text"] or "").split())
    assert all(abs(taken[n] - want[n]) <= 60 for n in names)


def test_repeats_of_51_words_go(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 7))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, short, tiny = prose(51), prose(50), " ".join(rng.choice("abcdefgh") for _ in range(51))
    assert len(long) < 400
    texts = [f"{prose(n)} {p} {prose(70)}" for p in (long, short, tiny) for n in (60, 80)] + [prose(300), None, f"x{long} {prose(9)} {tiny.replace(' ', chr(10))}"]
    docs = spark.createDataFrame([(k, t, "en", "s", t and len(t)) for k, t in enumerate(texts)], SCHEMA)
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    for k, p in enumerate((long, long, short, short, tiny, tiny)):
        before, after = texts[k].split(p)
        assert kept[k] == (texts[k] if p == short else before + after)
    assert kept[6] == texts[6] and kept[7] is None and kept[8] == texts[8][: -len(tiny)]


def test_repeats_in_one_text_and_across_blocks(spark, monkeypatch):
    from graphquarry.llm import substrings

    monkeypatch.setattr(substrings, "BLOCK_BYTES", 200)
    rng = random.Random(10)
    prose = lambda n: " ".join(str(rng.randrange(100000)) for _ in range(n))
    twice, shared = prose(55), prose(52)
    texts = [f"{prose(9)} {twice} {prose(9)} {twice} {prose(9)}", *(f"{prose(30)} {shared} {prose(30)}" for _ in range(20)), "buy " * 60]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    kept = [r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()]
    assert sorted(kept) == sorted([t.replace(twice, "").replace(shared, "") for t in texts[:-1]] + [" "])


CLASHES = ["score", "n_features", "log_weight", "weight", "key", "accepted", "toxicity", "__text", "__noise", "__block", "__id", "kept", "spans", "found", "set_name", "component_id", "n_shingles", "id", "k", "c", "c0", "c1", "bits", "part",
           "size", "source_size", "target", "draws", "taken", "shard", "epoch", "place", "__u", "__k", "__b", "__s", "__took", "start", "end", "edits", "item_id"]


def test_clashing_columns_nulls_and_empty_tables(spark, tmp_path):
    rng = random.Random(12)
    prose = lambda n: " ".join(str(rng.randrange(5000)) for _ in range(n))
    where, shared = str(tmp_path), prose(80)
    texts = [prose(rng.randint(20, 90)) for _ in range(30)] + [f"{prose(40)} {shared} {prose(40)}" for _ in range(3)] + ["!! ## " * 30] * 4 + [None, "", "one", prose(40_000)]
    rows = [(k if k % 11 else None, t, "en", None if k % 7 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)] + [(3, texts[3], "en", "s0", len(texts[3]))]
    extra = len(CLASHES)
    docs = spark.createDataFrame([(*r, *([r[0]] * extra)) for r in rows], SCHEMA + "".join(f", `{c}` long" for c in CLASHES))
    plain = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(k, int(k < 33), 0) for k in range(37)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, prose(25))], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got, want = stage(spark, docs, where), stage(spark, plain, where)
        if name != "mix":
            assert got.columns == docs.columns
        else:
            assert got.columns[-3:] == ["mix_shard", "mix_epoch", "mix_place"] and want.columns[-3:] == ["shard", "epoch", "place"]
        rows_of = lambda df: sorted(map(str, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))
        if name in ("near_duplicates", "repeats", "benchmark"):
            assert rows_of(got) == rows_of(want)
        assert all(r["doc_id"] == r["score"] == r["__u"] for r in got.collect())
        assert stage(spark, docs.limit(0), where).count() == 0
