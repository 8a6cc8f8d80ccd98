"""Small fixtures and brute-force versions for the corpus operators."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seismark.llm import chat, decontaminate, graph, licenses, lines, packing, quality, sharding, simhash, toxicity, urls
from seismark.llm.cuckoo import CuckooFilter
from seismark.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


ODD = [None, "", "   \n\t", "one", "a b\n\nc", "word " * 5000, "same text here " * 9, "same text here " * 9]


#: Names that operators use inside, and some that they return.
CLASHES = (
    "n_words", "fp", "shard", "slot", "digest", "g", "_measures", "_by_words", "_m_n_words", "_kept", "kept", "n_lines", "n_dropped", "_id", "text_", "gone", "_lost", "pad",
    "_near_id", "_near_digest", "_hits0", "hits", "_spans", "_doc", "_digest", "id", "first", "head", "root", "keys", "sketch", "size", "d", "n", "v", "_row", "_b", "_h", "_task",
)


def odd(spark):
    """Nulls, blanks, a long text, repeated rows, a null id and columns with clashing names."""
    d = docs(spark, ODD).withColumns({name: F.lit(k) if k % 2 else F.lit(f"{k}") for k, name in enumerate(CLASHES)})
    return d.unionByName(d.filter("doc_id = 6")).unionByName(d.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))


IDS = [0, 1, 2, 3, 4, 5, 6, 6, 7, None]
DOC_OPS = {
    "op1": quality.op1_query, "op3": sharding.op3_query, "op4": simhash.op4_query, "op5": licenses.op5_query, "op7": lines.op7_query, "op9": packing.op9_query,
    "op6": lambda d: decontaminate.op6_query(d, d.sparkSession.createDataFrame([("a", "same text here"), (None, None), ("e", "")], "item_id string, text string")),
    "op10": lambda d: toxicity.op10_query(d, d.sparkSession.createDataFrame([(3, 1, None), (4, 0, 1), (99, 1, 1)], "doc_id long, toxic int, quality int")),
}


def text_of(i):
    return ODD[3] if i is None else ODD[i] or ""


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_odd_rows_have_their_values(spark):
    got = {name: sorted(op(odd(spark)).collect(), key=lambda r: (r.doc_id is None, r.doc_id)) for name, op in DOC_OPS.items()}
    for name, rows in got.items():
        assert [r.doc_id for r in rows] == (IDS if name != "op9" else [0, 1, 2, 3, 4, 5, 5, 5, 5, 6, 6, 7, None]), name
        assert DOC_OPS[name](odd(spark).limit(0)).count() == 0
    words = {i: text_of(i).split() for i in IDS}
    assert [r.n_words for r in got["op1"]] == [len(words[i]) for i in IDS] and not any(r.kept for r in got["op1"])
    assert [(r.word_chars, r.n_repeat_words) for r in got["op1"]] == [(len("".join(words[i])), len(words[i]) if len(words[i]) > 8 else 0) for i in IDS]
    assert [(r.size, r.text_crc32) for r in got["op3"]] == [(len(text_of(i)) + 16, zlib.crc32(text_of(i).encode())) for i in IDS]
    assert len({(r.shard, r.slot) for r in got["op3"]}) == 10 and max(Counter(r.shard for r in got["op3"]).values()) == 1
    blank, hot = {0, 1, 2}, {6, 7}
    assert [r.component_id for r in got["op4"]] == [0 if i in blank else 6 if i in hot else 3 if i is None else i for i in IDS]
    assert [r.fingerprint for r in got["op4"]] == [f"{simhash.fingerprint(text_of(i).encode()) % 2**64:016x}" for i in IDS]
    assert [(r.license_id, r.notices, r.policy) for r in got["op5"]] == [(None, "", "none")] * 10
    assert [r.text_sha256 for r in got["op5"]] == [sha(" ".join(words[i])) for i in IDS]
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got["op6"]] == [(len(words[i]), 27, 1, sha("a")) if i in hot else (len(words[i]), 0, 0, sha("")) for i in IDS]
    assert [(r.n_lines, r.n_dropped, r.kept_sha256) for r in got["op7"]] == [(text_of(i).count("\n") + 1, 0, sha(text_of(i))) for i in IDS]
    assert [r.held_out for r in got["op10"]] == [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in IDS]
    by_text = {}
    for r in got["op10"]:
        by_text.setdefault(text_of(r.doc_id), set()).add(r.score)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert all(len(x) == 1 for x in by_text.values())


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_columns(spark, k):
    good = " ".join(f"the w{i} of" for i in range(30)) + "."
    d = odd(spark)
    extra = d.filter("doc_id = 4").withColumns({"doc_id": F.lit(8).cast("long"), "text": F.lit(good), "n_chars": F.lit(len(good)).cast("long")})
    d = d.unionByName(extra)
    out = corpus_pipeline.STAGES[k][1](spark, d, SF)
    assert corpus_pipeline.STAGES[k][1](spark, d.limit(0), SF).count() == 0
    if k == len(corpus_pipeline.STAGES) - 1:
        return
    assert out.columns == d.columns
    kept = {0: [8], 1: [*IDS[:-1], 8, None], 2: [0, 3, 4, 5, 6, 8], 3: [*IDS[:-1], 8, None]}[k]
    rows = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [r.doc_id for r in rows] == kept
    for r in rows:
        whole = good if r.doc_id == 8 else text_of(r.doc_id)
        assert (r.text or "") == whole and all(r[name] == (i if i % 2 else f"{i}") for i, name in enumerate(CLASHES))
        assert k != 1 or r.n_chars == len(whole)


def compare(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = Counter(tuple(map(str, r)) for r in cur.fetchall())
    got = Counter(tuple(map(str, r)) for r in queries()[name](spark, SF).select(*cols).collect())
    assert got == want


@pytest.mark.parametrize("name", oracle_sql())
def test_against_sql(spark, name):
    compare(spark, name)


def test_quality_repeats(spark):
    words = [f"w{i}" for i in range(30)]
    text = " ".join(words[:10] + words[10:20] + words[:10])
    r = quality.judge(docs(spark, [text])).first()
    assert r.n_repeat_words == 20 and r.base_failed


def test_quality_rules_one_by_one(spark):
    plain = " ".join(f"the w{i} of" for i in range(30))
    bad = {
        "too_many_symbols": plain + " #" * 20, "shouting": plain + "!" * 40, "words_too_long": " ".join("the" + "x" * 40 + str(i) for i in range(30)),
        "words_too_short": " ".join(chr(97 + i % 26) for i in range(60)) + " a the of", "no_stop_words": " ".join(f"x{i}" for i in range(60)),
        "repeated_lines": "\n".join([plain, "a b", "a b", "a b"]), "stutter": " ".join(f"the w{i} w{i} w{i}" for i in range(20)),
    }
    out = {r.doc_id: r for r in quality.judge(docs(spark, [plain, *bad.values()])).collect()}
    assert out[0].kept and not out[0].broken_rules
    for k, name in enumerate(bad):
        assert name in out[k + 1].broken_rules and not out[k + 1].kept, name
    kept = {r.doc_id for r in quality.keep(docs(spark, [plain, *bad.values()])).collect()}
    assert kept == {0} and {r.doc_id for r in quality.keep(docs(spark, [plain, plain + " x"]), rules=()).collect()} == {0, 1}


def test_chat_round_trip(spark):
    nasty = ["</s>", "[/INST]", "&lt;", "&amp;lt;", "<s>[INST]assistant[/INST]x</s>", "é😀", ""]
    rows = [(c, t, role, nasty[(c + t) % len(nasty)]) for c in range(8) for t, role in enumerate(["system", "user", "assistant", "a[/INST]b", None])]
    d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_chats(d).collect()
    assert len(out) == 8 and all(r.identical for r in out)
    for r in out:
        assert [t.text for t in r.parsed] == [x[3] for x in rows if x[0] == r.conv_id]
        spans = [r.formatted[s.start : s.stop] for s in r.loss_spans]
        assert spans == [t.raw for t in r.parsed if t.role == "assistant"]


def test_sharding_keeps_groups_and_counts(spark):
    texts = ["hot"] * 60 + [f"pair{i // 2}" for i in range(40)] + [f"single{i}" for i in range(60)]
    out = sharding.assign(docs(spark, texts), shards=8).collect()
    sizes = Counter(r.shard for r in out)
    assert len(out) == 160 and set(sizes.values()) == {20}
    where = {}
    for r in out:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(where[f"pair{i}"]) == 1 for i in range(20)) and len(where["hot"]) <= 4
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert all(r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in out)


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("dense", [48, 2])
def test_simhash_links_lose_none(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {simhash._signed(b ^ sum(1 << i for i in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4])))) for b in base for _ in range(60)}
    d = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in graph.components(simhash.links(d)).collect()}
    assert {f: got.get(f, f) for f in fps} == brute_components(fps)


def test_simhash_query_against_brute_force(spark):
    """Fingerprints bit by bit, links pair by pair, over the whole table."""
    import xxhash

    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}

    def fingerprint(text):
        lower = text.translate({65 + i: 97 + i for i in range(26)})
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = {i: fingerprint(t) for i, t in rows.items()}
    roots, least = brute_components(set(prints.values())), {}
    for i in sorted(rows):
        least.setdefault(roots[prints[i]], i)
    want = {i: (f"{f:016x}", least[roots[f]]) for i, f in prints.items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op4_simhash"](spark, SF).collect()} == want


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [r for r in queries()["op10_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    hit = Counter((labels[r.doc_id], r.predicted) for r in out)
    assert hit[0, 1] <= 0.02 * (hit[0, 0] + hit[0, 1]) and hit[1, 1] >= 0.9 * (hit[1, 0] + hit[1, 1]) > 0


def test_near_dedup_keeps_one_row_of_each_group(spark):
    x, y = "one two three four five six", "seven eight nine ten eleven twelve"
    ids = [(1, x), (1, x), (2, x), (3, y), (3, y), (1, y), (None, x), (None, "alone here"), (None, "alone here"), (4, None), (5, ""), (6, x), (6, "of its own")]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in ids], DOC)
    got = sorted(((r.doc_id, r.text) for r in simhash.keep(d).collect()), key=str)
    assert got == sorted([(1, x), (1, y), (None, "alone here"), (4, None), (6, "of its own")], key=str)
    assert simhash.keep(d).columns == d.columns


def test_fingerprint_by_definition():
    import xxhash

    text = "The quick brown fox JUMPS over the lazy dog the quick brown fox"
    w = text.lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text.encode()) % 2**64 == want and simhash.fingerprint(None) == 0


def test_license_digests(spark):
    mit = licenses.LIBRARY[0][2]
    british = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ;")
    out = {r.doc_id: r for r in licenses.op5_query(docs(spark, [british, "text\nlicensed under the APACHE licence version 2.0\nmore", "plain"])).collect()}
    assert out[0].license_id == "MIT" and out[1].notices == "Apache-2.0" and out[2].policy == "none"


@pytest.mark.parametrize("limit", [5_000, 3])
def test_whole_licence_texts(spark, monkeypatch, limit):
    """The library broadcast, and joined as one too large for that."""
    from pathlib import Path

    monkeypatch.setattr(licenses, "LIBRARY_ROWS", limit)
    folder = Path("/usr/share/common-licenses")
    texts = {name: (folder / name).read_text() for name in ("Apache-2.0", "GPL-3", "MPL-2.0") if (folder / name).exists()}
    wrapped = {f"{k} in one line": " ".join(v.split()) for k, v in texts.items()}
    unlicense = next(t for i, _, t in licenses.LIBRARY if t.startswith("This is free"))
    every = {**texts, "u": "Copyright 2020 A. Person\n\n" + unlicense.lower(), "both": "SPDX-License-Identifier: EPL-2.0\nSPDX-License-Identifier: MIT\ntext", "none": None, "empty": ""}
    out = {r.doc_id: r for r in licenses.op5_query(docs(spark, list(every.values()))).collect()}
    got = {k: (out[i].license_id, out[i].notices, out[i].policy) for i, k in enumerate(every)}
    assert got["u"][0] == "Unlicense" and got["both"] == (None, "EPL-2.0,MIT", "copyleft")
    assert got["none"] == got["empty"] == (None, "", "none") and out[len(every) - 1].text_sha256 == out[len(every) - 2].text_sha256
    if texts:
        assert [got[k][0] for k in texts] == ["Apache-2.0", "GPL-3.0", "MPL-2.0"] and got["GPL-3"][2] == "copyleft"
    assert len(wrapped) == len(texts)


def test_chat_grammar_refuses(spark):
    good, bad = "<s>[INST]user[/INST]hi</s>", ["XXXXXXXXXuser[/INST]hi</s>", "<s>[INST]user[/INST]hi</s>x", "<s>[INST]user hi</s>", "hi", "<s>[INST]user[/INST]hi</s><s>[INST</s>"]
    d = spark.createDataFrame([(x,) for x in [good, *bad, ""]], "f string").select("f", chat.parse(F.col("f")).alias("p"))
    out = {r.f: r.p for r in d.collect()}
    assert [(t.role, t.text) for t in out[good]] == [("user", "hi")] and out[""] == [] and all(out[x] is None for x in bad)


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x" * 100_000), (None, 0, "user", "a"), (None, 0, "user", "a"), (2, 1, "assistant", "é😀"), (2, 0, "user", "")]
    d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"formatted": F.lit(1), "t": F.lit(2), "_alone": F.lit(3)})
    got = sorted((r.conv_id or 0, [(t.role, t.text) for t in r.parsed]) for r in chat.format_chats(d).collect())
    assert got == [(0, [("user", "a")]), (0, [("user", "a")]), (1, [("", "x" * 100_000), ("user", ""), ("user", "")]), (2, [("user", ""), ("assistant", "é😀")])]
    q = {r.conv_id: r for r in chat.op2_query(d).collect()}
    assert q[2].loss_chars == 2 and q[1].n_turns == 3 and q[-7].n_turns == 2 and q[1].loss_chars == 0
    assert chat.format_chats(d.limit(0)).count() == 0 and chat.op2_query(d.limit(0)).count() == 1


def test_windows_in_blocks_agree(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(f"i{k}", " ".join(rng.choices(vocabulary, k=rng.choice([4, 14])))) for k in range(12)]
    d = docs(spark, [" ".join(rng.choices(vocabulary, k=60)) + " X. " + items[k % 12][1] for k in range(20)])
    bench = spark.createDataFrame(items, "item_id string, text string")
    d = d.unionByName(d.filter("doc_id = 3")).unionByName(d.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))).withColumns({"hits": F.lit(1), "_doc": F.lit(2)})
    run = lambda n: sorted(str((r.doc_id, r["_hits"])) for r in decontaminate.scan(d, bench, n)[0].collect())
    assert run(10**6) == run(1) == run(7)
    assert len(list(decontaminate.blocks(bench, 1))) > 5 and len(list(decontaminate.blocks(bench))) == 1
    d = d.drop("hits", "_doc").filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    clean = decontaminate.cut_spans(d, bench)
    assert clean.columns == d.columns and clean.count() == 20
    assert all(items[r.doc_id % 12][1] not in r.text for r in clean.collect())


def opened(state):
    return np.frombuffer(b"".join(state.filters.opened().blobs.values()), np.uint16)


def table_of(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


def test_line_state_is_reversible(spark):
    long_line = "this line is long enough to count"
    a, b = docs(spark, [long_line, long_line, "x"]), docs(spark, ["", "", "", long_line + "\nrest", long_line]).filter("doc_id > 2")
    first = lines.start(a)
    both = lines.insert(first, b)
    back = lines.delete(both, b.select("doc_id"))
    assert both.repeated.count() == 1 and back.repeated.count() == 0 and first.repeated.count() == 0
    assert np.count_nonzero(opened(both)) == 1 and not opened(back).any()
    kept = {r.doc_id: r.kept for r in lines.apply(both, a.unionByName(b)).collect()}
    assert kept == {0: "", 1: "", 2: "x", 3: "rest", 4: long_line}


def test_line_batches_equal_one_start(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    parts = [d.filter(F.col("doc_id") % 3 == k) for k in range(3)]
    whole, state = lines.start(d), lines.start(parts[0])
    for p in (parts[1], parts[2], parts[1]):  # a batch that is there already changes nothing
        state = lines.insert(state, p)
    assert table_of(state.refs) == table_of(whole.refs)
    lines.save(state, str(tmp_path / "s"))
    state = lines.load(spark, str(tmp_path / "s"))
    less = lines.delete(state, parts[2].select("doc_id"))
    want = lines.start(parts[0].unionByName(parts[1]))
    assert table_of(less.refs) == table_of(want.refs) and table_of(less.repeated) == table_of(want.repeated)
    keys = lines._pairs([bytes(r.digest) for r in less.repeated.collect()])
    assert less.filters.opened().holds(keys).all()
    # a mark for each line at the limit, no more: what went is out of the filters
    assert np.count_nonzero(opened(less)) == less.n_repeated


@pytest.mark.parametrize("limits", [(0, 30_000, 16), (0, 1, 1), (10**6, 3, 16)])
def test_lines_alike_at_every_size(spark, monkeypatch, limits):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    nulls = d.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    d = d.unionByName(nulls).unionByName(nulls)
    want = table_of(lines.op7_query(d))
    for name, value in zip(("BROADCAST_LINES", "SHARD_KEYS", "CELLS"), limits, strict=True):
        monkeypatch.setattr(lines, name, value)
    asked = []
    real = CuckooFilter.load
    monkeypatch.setattr(CuckooFilter, "load", classmethod(lambda cls, blob: asked.append(1) or real(blob)))
    state = lines.start(d)
    assert state.filters.table.count() == max(1, -(-state.n_repeated // limits[1])) or limits[1] < 30_000
    assert state.filters.size > 0 and table_of(lines.op7_query(d)) == want


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys, other = (rng.integers(0, 2**63, (5000, 2)).astype(np.uint64) for _ in range(2))
    f = CuckooFilter.sized(len(keys))
    assert f.insert(keys) and f.holds(keys).all() and f.holds(other).mean() < 0.01
    f.delete(keys[:2500])
    assert f.holds(keys[2500:]).all() and f.holds(keys[:2500]).mean() < 0.01


@pytest.mark.parametrize(("size", "levels", "opened"), [(urls.BLOCK_BYTES, urls.MAX_LEVELS, 8), (100, urls.MAX_LEVELS, 8), (100, 2, 1), (20, 1, 0)])
def test_cascade_is_exact(spark, monkeypatch, size, levels, opened):
    """One block and many, all open or one at a time, and with a tail for what the levels leave."""
    monkeypatch.setattr(urls, "OPEN_BLOCKS", opened)
    keys = spark.range(3000).select(F.format_string("h%d.example", "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascades = urls.build(keys, size, levels)
    assert (len(cascades) > 1) == (size < 1000) and all(len(c.levels) <= levels for c in cascades)
    assert urls.with_listed(keys, "key", cascades, "got").filter("got <> listed").count() == 0
    assert (levels > 2) or any(c.tail for c in cascades)


def test_cascade_tells_keys_of_one_hash_apart(spark, monkeypatch):
    monkeypatch.setattr(urls, "_hashes", lambda key: (F.lit(5).cast("long"), F.lit(7).cast("long")))
    keys = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("", False)], "key string, listed boolean")
    assert urls.with_listed(keys, "key", urls.build(keys), "got").filter("got <> listed").count() == 0


def test_url_odd_rows(spark):
    rows = [(0, None), (0, None), (None, "http://free-bets.example.com/de/"), (1, "http://a.free-bets.example.net/" + "x" * 100_000), (2, ""), (3, "://"), (4, "http://ORG/es/"), (5, "http://a.com/de/#x?"), (6, "a\nb://x.com/fr/y")]
    d = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "listed": F.lit(2), "key": F.lit(3), "_listed": F.lit(4)})
    got = sorted((str(r.page_id), r.host, r.rule, r.verdict) for r in urls.op8_query(d).collect())
    want = [("0", "", None, "allow")] * 2 + [("1", "a.free-bets.example.net", None, "block"), ("2", "", None, "allow"), ("3", "", None, "allow"), ("4", "org", "org/", "allow"),
            ("5", "a.com", "com/de/", "block"), ("6", "x.com", "com/fr/", "allow"), ("None", "free-bets.example.com", "com/de/", "block")]
    assert got == want
    big = spark.createDataFrame([("com",), ("x.y",)], "domain string")
    hosts = spark.createDataFrame([("a.com",), ("com",), ("xcom",), ("z.x.y",), ("y",), ("",)], "host string")
    assert {r.key for r in urls.universe_of(hosts, big).filter("listed").collect()} == {"a.com", "com", "z.x.y"}


def test_url_rules(spark):
    rows = [(0, "http://a.Example.org/es/1"), (1, "https://example.org/en/12?x"), (2, "x://org"), (3, None), (4, "no scheme"), (5, "http://spam-farm.example.net#a")]
    d = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in urls.op8_query(d).collect()}
    assert got[0] == ("a.example.org", "example.org/es/", "block") and got[1][1] == "example.org/en/1" and got[2] == ("org", None, "allow")
    assert got[3] == got[4] == ("", None, "allow") and got[5][2] == "block" and urls.op8_query(d.limit(0)).count() == 0


def test_best_fit_is_valid_and_tight():
    rng = random.Random(0)
    sizes = [rng.randint(1, 8192) for _ in range(500)]
    bins = {}
    for n, (b, offset, cap) in zip(sizes, packing.best_fit(sizes), strict=True):
        bins.setdefault(b, []).append((offset, n, cap))
    for held in bins.values():
        at = 0
        for offset, n, cap in sorted(held):
            assert offset == at and at + n <= cap
            at += n
        assert cap == min(c for c in packing.LENGTHS if c >= at)
    assert sum(sizes) / sum(h[0][2] for h in bins.values()) > 0.95


def least_cost(sizes, lengths, overhead, square):
    """The cost of the best way to put all sizes into bins, by trying every bin for the first of them."""
    from functools import lru_cache
    from itertools import combinations

    @lru_cache(None)
    def best(left):
        if not left:
            return 0
        head, rest, least = left[0], left[1:], float("inf")
        for k in range(len(rest) + 1):
            for mates in combinations(range(len(rest)), k):
                total = head + sum(rest[m] for m in mates)
                if total <= lengths[-1]:
                    c = packing.cost(next(x for x in lengths if x >= total), overhead, square)
                    least = min(least, c + best(tuple(r for m, r in enumerate(rest) if m not in mates)))
        return least

    return best(tuple(sorted(sizes, reverse=True)))


def test_best_fit_near_the_optimum():
    rng, lengths, ratios = random.Random(4), (8, 16, 32), []
    for _ in range(60):
        sizes = [rng.randint(1, rng.choice([6, 16, 32])) for _ in range(rng.randint(1, 8))]
        made = packing.best_fit(sizes, lengths, 1, 256)
        got = sum(packing.cost(c, 1, 256) for c in {b: c for b, _, c in made}.values())
        ratios.append(got / least_cost(sizes, lengths, 1, 256))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) < 1.35 and sum(ratios) / len(ratios) < 1.04
    # what is left decides: eight small pieces fill two short bins at less than a long one costs
    assert {c for _, _, c in packing.best_fit([1000] * 8, (1024, 8192), 0, 8192)} == {1024}
    assert {c for _, _, c in packing.best_fit([1000] * 8, (1024, 8192), 4096, 1 << 30)} == {8192}


def test_bins_mix_lengths_and_do_not_depend_on_layout(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = packing.pack(d, task_pieces=400)
    assert {r.bin_capacity for r in packing.fill(packing.pack(d)).filter("bins > 3").collect()} >= {2048, 4096, 8192}
    total = packing.fill(packing.pack(d)).agg(F.sum("tokens").alias("t"), F.sum(F.col("bins") * F.col("bin_capacity")).alias("c")).first()
    assert total.t > 0.98 * total.c
    assert table_of(one) == table_of(packing.pack(d.repartition(7, "text"), task_pieces=400))
    used = one.groupBy("bin_id").agg(F.sum("n_tokens").alias("n"), F.max("bin_capacity").alias("c"), F.count_distinct("bin_capacity").alias("k"))
    assert used.filter("n > c OR k > 1").isEmpty()


def test_packing_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "EQUAL_PIECES", 4)
    d = odd(spark).withColumns({"bin_id": F.lit("x"), "_h": F.lit(1), "_task": F.lit(2), "n_tokens": F.lit(0)})
    d = d.unionByName(d.filter("doc_id = 6")).unionByName(d.filter("doc_id = 6")).unionByName(d.filter("doc_id = 6"))
    out = packing.pack(d, task_pieces=3).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1) for r in d.collect())
    got = Counter()
    for r in out:
        got[r.doc_id] += r.n_tokens
    assert got == Counter({i: sum(n * c for (x, n), c in want.items() if x == i) for i, _ in want}) and packing.pack(d.limit(0)).count() == 0
    held = {}
    for r in out:
        held.setdefault(r.bin_id, []).append((r.bin_offset, r.n_tokens, r.bin_capacity))
    for rows in held.values():
        at = 0
        for offset, n, cap in sorted(rows):
            assert offset == at and at + n <= cap
            at += n


def test_packing_holds_every_byte(spark):
    d = docs(spark, [None, "", "x" * 20_000, "é" * 100, "x" * 8191, "y"])
    out = packing.pack(d).collect()
    total = Counter()
    for r in out:
        total[r.doc_id] += r.n_tokens
    assert total == {0: 1, 1: 1, 2: 20_001, 3: 201, 4: 8192, 5: 2}
    assert packing.pack(d.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(1500):
        bad = i % 8 == 0
        t = rng.choices(words, k=40) + (["Awful!", "vile,"] if bad else [])
        rng.shuffle(t)
        texts.append(" ".join(t))
        labels.append((i, int(bad)))
    out = toxicity.op10_query(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == labels[r.doc_id][1] for r in held) / len(held) > 0.97


def brute_pipeline(rows, items):
    """The first four stages on plain Python rows: doc_id -> text."""
    def measures(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        g = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + k for i in range(len(w) - 7) if g[tuple(w[i : i + 8])] > 1 for k in range(8)}
        ls = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        return dict(n_words=len(w), word_chars=sum(map(len, w)), n_symbols=sum(c in "#*$%&|<>" for c in t), n_exclaims=t.count("!"), n_repeat_words=len(hit),
                    n_dup_lines=len(ls) - len(set(ls)), n_text_lines=len(ls), n_stutter=sum(a == b for a, b in zip(w, w[1:])), n_stop_words=sum(x.lower() in quality.STOP_WORDS for x in w))

    def good(t):
        m = measures(t)
        if m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]:
            return False
        past = lambda r: m[r.measure] * 100 > m[r.of] * r.percent if r.side == "max" else m[r.measure] * 100 < m[r.of] * r.percent
        return not any(m[r.of] >= r.floor and past(r) for r in quality.RULES)

    rows = {i: t for i, t in rows.items() if good(t)}
    holders = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({65 + i: 97 + i for i in range(26)})
    for i, t in rows.items():
        for x in {key(y) for y in t.split("\n")}:
            if len(x) >= 20:
                holders.setdefault(x, set()).add(i)
    gone = {x: max(h) for x, h in holders.items() if len(h) >= 3}
    rows = {i: "\n".join(y for y in t.split("\n") if gone.get(key(y), i) == i) for i, t in rows.items()}
    # near duplicates: sets of five-word shingles with a Jaccard similarity of 0.8 or more, and all they reach
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.translate({65 + i: 97 + i for i in range(26)})) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, head = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}
    for i in sorted(rows):
        for k in sorted(rows):
            if k < i and head[i] != head[k] and len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k]):
                low, high = sorted((head[i], head[k]))
                head = {x: low if h == high else h for x, h in head.items()}
    rows = {i: t for i, t in rows.items() if head[i] == i}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({65 + i: 97 + i for i in range(26)}))
    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    dirty = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    return {i: t for i, t in rows.items() if not dirty(words(t))}


def test_pipeline_against_brute_force(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = brute_pipeline(rows, [r.text or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    out = corpus_pipeline.run(spark, SF).collect()
    tokens = Counter()
    for r in out:
        tokens[r.doc_id] += r.n_tokens
    assert tokens == {i: len(t.encode()) + 1 for i, t in want.items()}


@pytest.mark.parametrize("dense", [48, 2])
def test_near_dedup_finds_all_texts_of_similarity_08(spark, monkeypatch, dense):
    from seismark.llm import similar

    monkeypatch.setattr(similar, "DENSE", dense)
    rng, texts = random.Random(3), []
    for family in range(6):
        base = [f"w{family}x{rng.randrange(10**6)}" for _ in range(150)]
        for copy in range(12):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                words[rng.randrange(150)] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    got = {r.doc_id for r in simhash.keep(docs(spark, texts)).collect()}
    assert got == set(root) and len(got) < len(texts)
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    parts = brute_components(set(prints))
    assert len({parts[f] for f in prints}) > len(got)


def test_sharding_against_brute_force(spark):
    """Rows, sizes and digests by definition; counts, slots and links counted one by one; no single move within quota cuts less."""
    rng = random.Random(9)
    texts = [rng.choice(["a", "b" * 9, "c é", None, ""]) if rng.random() < 0.3 else f"t{rng.randrange(40)}" for _ in range(150)] + [f"alone {i}" for i in range(83)]
    d = docs(spark, texts)
    out = sharding.assign(d.withColumns({"g": F.lit(1), "n": F.lit(2), "_row": F.lit(3)}), shards=6).collect()
    assert sorted(r.doc_id for r in out) == list(range(233))
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(6))
    plain = lambda t: (t or "").encode()
    assert all((r.size, r.text_crc32) == (len(plain(texts[r.doc_id])) + 16, zlib.crc32(plain(texts[r.doc_id]))) for r in out)
    place = {r.doc_id: r.shard for r in out}
    mates = [(i, k) for i in range(233) for k in range(i) if plain(texts[i]) == plain(texts[k])]
    counted = sharding.links(spark.createDataFrame([(texts[i] or "", s) for i, s in place.items()], "g string, shard int")).first()
    assert counted.links == len(mates) and counted["cut"] == sum(place[i] != place[k] for i, k in mates)
    assert counted.parted <= 6 and counted["cut"] < 0.35 * counted.links
    again = {r.doc_id: r.shard for r in sharding.assign(d, shards=6).collect()}
    assert place == again


@pytest.mark.parametrize("copies", [4, 7])
def test_sharding_keeps_groups_without_singles(spark, copies):
    texts = [f"copy{i // copies}" for i in range(60 * copies)]
    out = sharding.assign(docs(spark, texts), shards=8).collect()
    sizes = Counter(r.shard for r in out)
    assert len(out) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1
    where = {}
    for r in out:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(w) > 1 for w in where.values()) < 8 and max(map(len, where.values())) <= 2


def test_near_dedup_candidates_are_simhash_keys():
    """Signs of sums of shingle vectors; pairs of 0.8 share keys and pass the sketch, others do neither."""
    from seismark.llm import similar

    rng = np.random.default_rng(4)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    x, y = np.unique(draw(300)), np.unique(draw(200))
    both = np.concatenate([x, y])
    assert np.allclose(similar.sums(both), similar.sums(x) + similar.sums(y), atol=1)  # each shingle adds its vector
    differ = lambda a, b: sum(int(v).bit_count() for v in (a ^ b).view(np.uint64))
    for same, own in ((8, 1), (400, 50), (4000, 500)):
        shared, off = [], []
        for _ in range(40):
            common = draw(same)
            (a, p), (b, q) = (similar.signature(np.concatenate([common, draw(own)])) for _ in range(2))
            shared.append((a == b).sum())
            off.append(differ(p, q))
        assert min(shared) >= 1 and 10 < np.mean(shared) < 15 and max(off) <= similar.SKETCH_OFF
    (a, p), (b, q) = similar.signature(draw(450)), similar.signature(draw(450))
    assert len(a) == len(set(a.tolist())) == similar.KEYS and not (a == b).any() and differ(p, q) > 400
    assert len(similar.signature(draw(3))[0]) == 0


def test_components_on_the_driver_equal_steps(spark):
    rng = random.Random(6)
    d = spark.createDataFrame([(rng.randrange(300) - 150, rng.randrange(300) - 150) for _ in range(170)], "a long, b long")
    sides = [{r.node: r.root for r in graph.components(d, local).collect()} for local in (0, 1000)]
    assert sides[0] == sides[1] and len(set(sides[0].values())) > 5


def test_sharding_moves_run_on_the_driver(spark):
    """Groups across bounds are put together within the quotas; pieces cover every place once; few exchanges."""
    pieces = sharding._pieces([(8, 4), (18, 5)], 30, 60, 3, None)  # bounds at 10 and 20, limits of 20
    ends = [*(p for p, _, _ in pieces[1:]), 60]
    where = [(s, k + i - p) for (p, s, k), end in zip(pieces, ends, strict=True) for i in range(p, end)]
    assert sorted(where) == [(s, k) for s in range(3) for k in range(20)]
    assert all(len({s for s, _ in where[lo : lo + n]}) == 1 for lo, n in ((8, 4), (18, 5)))
    out = sharding.assign(docs(spark, [f"t{i // 13}" for i in range(260)]), shards=8)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hash") <= 3
    assert sorted((r.shard, r.slot) for r in out.collect()) == [(s, k) for s in range(8) for k in range(33 if s < 4 else 32)]
