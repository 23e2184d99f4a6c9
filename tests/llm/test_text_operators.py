"""Token counts, packing, decontamination, line dedup, chat formatting, revisits and classifiers on small fixtures."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import chat_format, decontamination, line_dedup, packing, quality, token_counts, toxicity, warc
from quillspark.llm.common import fold_crc, words_of
from quillspark.llm.queries import op1_quality, op8_packing, op10_token_counts, tokenizer_path

PIECES = [" ", "  ", "a", "the", "\n", "\t", "▁", "</s>", "<|endoftext|>", "ß", "é", "😀", "\x00", "ing", ",", "...", "'s", "12", " ", "　"]


def odd_texts(n=3000):
    random.seed(4)
    return ["".join(random.choice(PIECES) for _ in range(random.randint(0, 9))) for _ in range(n)]


def test_token_counts_match_the_library(spark):
    counter = token_counts.counter(tokenizer_path("piece_bpe_32k.model"))
    texts = odd_texts()
    assert list(counter.count_all(pa.array(texts))) == [len(x) for x in counter.model.encode(texts)]
    rows = [(1, "hello world", 0), (1, "hello world", 1), (None, "", 2), (3, None, 3), (4, "x y " * 60_000, 4)]
    out = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens long"), tokenizer_path("piece_bpe_32k.model")).collect()
    hello = len(counter.model.encode("hello world"))
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out[:4]] == [(1, 11, hello, False), (1, 11, hello, False), (None, 0, 0, False), (3, 0, 0, False)]
    assert out[4].over_limit and out[4].n_tokens == len(counter.model.encode(rows[4][1]))


def test_memo_is_bounded_by_bytes():
    """Texts without spaces are words of their own: what stays in a worker is small, and ids and counts are the libraries'."""
    rng = np.random.default_rng(7)
    counter, tokens = token_counts.PieceCounter(tokenizer_path("piece_bpe_32k.model")), packing.ByteTokenizer(tokenizer_path("byte_bpe_50k.json"))
    assert counter.cuttable
    most = 0
    for batch in range(100):
        letters = rng.integers(97, 123, (1000, 300)).astype(np.uint8)
        texts = [row.tobytes().decode() for row in letters]  # one word of 300 bytes each
        texts[:50] = [" ".join(t[k : k + 6] for k in range(0, 300, 6)) for t in texts[:50]]  # and some of fifty short ones, none met before
        column = pa.array(texts)
        counts = counter.count_all(column)
        most = max(most, counter.memo.nbytes)
        if batch % 25 == 0:
            assert list(counts) == [len(x) for x in counter.model.encode(texts)]
        if batch < 20:
            ids, lens = tokens.ids(column)
            most = max(most, tokens.memo.nbytes)
            if batch % 10 == 0:
                want = [tokens.library.encode(t, add_special_tokens=False).ids for t in texts]
                assert lens.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    assert most < 40 << 20
    counter.memo.most = 1  # full at once: results stay the same
    assert list(counter.count_all(column)) == list(counts) and list(counter.count_all(column)) == list(counts)


def test_ids_match_the_library():
    own = packing.tokenizer(tokenizer_path("byte_bpe_50k.json"))
    texts = odd_texts()
    ids, lens = own.ids(pa.array(texts))
    ends = np.cumsum(lens)
    assert [list(ids[e - n : e]) for e, n in zip(ends, lens)] == [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9000), max_size=60))
def test_packing_places_each_token_once(lengths):
    rows = packing.pack(np.array(lengths, np.int64))
    for d, n in enumerate(lengths):
        own = rows[rows[:, 0] == d]
        assert own[:, 2].sum() == n and list(own[:, 1]) == [0, *np.cumsum(own[:, 2])[:-1]][: len(own)]
    for s in np.unique(rows[:, 3]):
        own = rows[rows[:, 3] == s]
        own = own[np.argsort(own[:, 4])]
        total = own[:, 2].sum()
        assert list(own[:, 4]) == [0, *np.cumsum(own[:, 2])[:-1]] and total <= 2048 and total & (total - 1) == 0


def test_least_squares():
    a, b = np.random.default_rng(0).random((12, 6)), np.random.default_rng(1).random(12)
    x = packing.nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope <= 1e-8).all() and np.abs(slope[x > 0]).max() < 1e-8


def test_packed_documents(spark):
    rows = [(1, "hello world"), (2, None), (2, ""), (None, "x"), (5, "word " * 5000)]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), tokenizer_path("byte_bpe_50k.json")).collect()
    own = packing.tokenizer(tokenizer_path("byte_bpe_50k.json"))
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    long = [x for r in sorted(out, key=lambda r: r.start) if r.doc_id == 5 for x in r.ids]
    assert long == [*own.library.encode(rows[4][1], add_special_tokens=False).ids, 1]
    assert sorted(r.ids[0] for r in out if r.doc_id == 2) == [1, 1]
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_queries_of_tokens_over_the_table(spark):
    """op8 and op10 over their whole table against the libraries, document by document."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    own, pieces = packing.tokenizer(tokenizer_path("byte_bpe_50k.json")), token_counts.counter(tokenizer_path("piece_bpe_32k.model"))
    found = {r.doc_id: r for r in op10_token_counts(spark, DATA).collect()}
    assert {d: (r.n_bytes, r.n_tokens, r.over_limit) for d, r in found.items()} == {d: (len(t.encode()), len(i), len(i) > 4096) for (d, t), i in zip(rows, pieces.model.encode([t for _, t in rows]))}
    ids = {d: np.array([*own.library.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in rows}
    packed, at, length = op8_packing(spark, DATA).collect(), defaultdict(int), defaultdict(list)
    for r in sorted(packed, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
        length[r.sequence_id].append((r.offset, r.length))
    assert at == {d: len(i) for d, i in ids.items()}
    for parts in length.values():
        parts.sort()
        ends = np.cumsum([n for _, n in parts])
        assert [o for o, _ in parts] == [0, *ends[:-1]] and ends[-1] <= 2048


def brute_overlap(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, body in items:
        w = words_of(body)
        k = min(8, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == w[i : i + k]:
                    found.add(item)
                    hit.update(range(j, j + k))
    return len(words), len(hit), sorted(found)


def test_wu_manber_against_brute_force(spark):
    random.seed(9)
    line = lambda n, of="abc": " ".join(random.choice(of) for _ in range(n))
    items = [(str(k), line(random.choice([0, 1, 2, 5, 8, 9, 30]), "abcd")) for k in range(25)] + [("7", line(9)), ("n", None)]
    docs = [(k, line(random.randint(0, 80), "abcdxy")) for k in range(60)] + [(90, None), (91, ""), (91, "A, b! " * 40)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for block in (1_000_000, 20):
        found = decontamination.find_overlaps(df, bench, block_words=block).collect()
        got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found)
        assert got == sorted((d, *brute_overlap(t, items)) for d, t in docs)
    assert decontamination.find_overlaps(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_passes_over_many_blocks_stay_small(spark):
    """Twenty blocks: each pass holds one of them, and what is left is a plan with one Python node per side."""
    items = [(str(k), f"u{k} v{k} w{k} x{k} y{k} z{k} a{k} b{k}") for k in range(200)]
    docs = [(k, f"before u{k} v{k} w{k} x{k} y{k} z{k} a{k} b{k} after" if k % 3 else "nothing here") for k in range(90)] + [(1, None), (2, "nothing here")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    words = sum(len(t.encode()) / 5 + 1 for _, t in items)
    found = decontamination.find_overlaps(df, bench, block_words=int(words / 20))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 2
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect()) == sorted((d, *brute_overlap(t, items)) for d, t in docs)
    whole = decontamination.decontaminate(df, bench)
    parts = decontamination.decontaminate(df, bench, block_words=int(words / 20))
    shown = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert shown(whole) == shown(parts) == sorted([(d, t) for d, t in docs if not brute_overlap(t, items)[1]], key=repr)


def test_decontamination_keeps_columns_of_any_name(spark):
    names = ["doc_id", "items", "text", "ranges", "t1", "_t1", "n_hit", "_found_items"]
    bench = spark.createDataFrame([(1, "p1 p2 p3 p4 p5 p6 p7 p8"), (2, "q1 q2")], "item_id long, text string")
    docs = spark.createDataFrame([(1, 1, "p1 p2 p3 p4 p5 p6 p7 p8", 1, 1, 1, 1, 1), (2, 2, "q1 q2 alone", 2, 2, 2, 2, 2), (2, 2, "q1 q2 alone", 2, 2, 2, 2, 2)], ", ".join(f"{n} {'string' if n == 'text' else 'long'}" for n in names))
    for size in (1_000_000, 3):
        out = decontamination.decontaminate(docs, bench, block_words=size)
        assert out.columns == names and [r.doc_id for r in out.collect()] == [2, 2]
        assert decontamination.decontaminate(docs.limit(0), bench, block_words=size).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == 3


def test_decontaminated_documents(spark):
    passage = "p1 p2 p3 p4 p5 p6 p7 p8 p9"
    docs = spark.createDataFrame([(1, f"Clean, {passage}; tail", 5), (2, "clean only", 6), (3, None, 7)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, passage), (2, "clean only two")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.decontaminate(docs, bench).collect()) == [2, 3]
    kept = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, action="excise").collect()}
    assert kept == {1: "Clean, ; tail", 2: "clean only", 3: None}


def test_lines(spark):
    rows = [(5, "Shared line one\nown\nshared LINE one \n"), (2, "x\nshared line one\nshared line one"), (7, "\tSHARED LINE ONE\x0b"), (7, "different text here\nsame"), (9, None), (10, ""), (None, "shared line one")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, row string, batch int")
    for batches in (1, 3):
        out = sorted(((r.doc_id or 0, r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.drop_lines(df, batches=batches, fan_out=2).collect()))
        assert out == [(0, "shared line one", 1, 0), (2, rows[1][1], 3, 0), (5, "own\n", 4, 2), (7, "", 1, 1), (7, "different text here\nsame", 2, 0), (9, "", 1, 0), (10, "", 1, 0)]
    assert line_dedup.drop_lines(df.limit(0)).count() == 0


def test_line_runs_are_levelled(spark):
    store = line_dedup.RunStore(spark, fan_out=2)
    for k in range(5):
        store.ingest(spark.createDataFrame([(10 * k + j, j + k, 0) for j in range(4)], "doc_id long, h1 long, h2 long"))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    owners = {r.h1: r.owner for r in store.read().collect()}
    assert owners == {0: 0, 1: 1, 2: 2, 3: 3, 4: 13, 5: 23, 6: 33, 7: 43}


def test_lines_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "_lines", "_gone", "_doc", "_row", "doc", "row", "gone", "lines", "n_lines"]
    df = spark.createDataFrame([(k, "the very same line\nown", *[str(k)] * 8, 5) for k in (1, 2)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names[2:-1]) + ", n_lines int")
    out = sorted(line_dedup.drop_lines(df).collect(), key=lambda r: r.doc_id)
    assert [(r._lines, r.doc, r.gone, r.kept_text, r.n_lines) for r in out] == [("1", "1", "1", "the very same line\nown", 2), ("2", "2", "2", "own", 2)]


def test_line_runs_meet_without_a_shuffle(spark):
    store = line_dedup.RunStore(spark)
    lines = spark.createDataFrame([(k, k, 0) for k in range(50)], "doc_id long, h1 long, h2 long")
    store.ingest(lines)
    fresh = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner")).join(spark.table(store.runs()[0]).hint("merge"), ["h1", "h2"], "left_anti")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    store.clear()
    assert not store.runs()


CHAT = st.text(alphabet=st.sampled_from(list("[]</>\\ISNTROLE=s ok\n|é")), max_size=14)


def test_chat_round_trip(spark):
    random.seed(7)
    bits = ["</s>", "[INST]", " [/INST]", "<s>", "[ROLE=x] ", " [/ROLE]", "\\", "<", "[", "/", " ", "\n", "ok", "é😀", "s>", "<\\", "<\\\\/s>", "INST]"]
    rows = [(c, t, random.choice(["user", "assistant", "system", "tool [/ROLE]", ""]), "".join(random.choice(bits) for _ in range(random.randint(0, 6)))) for c in range(60) for t in range(5)]
    rows += [(100, 0, "user", None), (100, 1, None, "x"), (100, 1, None, "x"), (None, None, "assistant", "y"), (101, 0, "assistant", "long [INST]" * 20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, nth int")
    whole = chat_format.format_conversations(df)
    plain = lambda r: r or ""
    want = {}
    for c in {r[0] for r in rows}:
        want[c] = [(plain(r[2]), plain(r[3])) for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, plain(r[2]), plain(r[3])))]
    for r in whole.collect():
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        spans = [r.formatted[s.start : s.end] for s in r.loss_spans]
        undone = spark.createDataFrame([(k, s) for k, s in enumerate(spans)], "k int, s string").orderBy("k").select(chat_format.unescape(F.col("s"))).collect() if spans else []
        assert [u[0] for u in undone] == [t for role, t in want[r.conv_id] if role == "assistant"]
    digest = {r.conv_id: r for r in chat_format.digests(whole).collect()}
    for c, turns in want.items():
        assert digest[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert whole.where("not identical or identical is null").count() == 0
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_a_conversation_that_differs_says_so(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "escape", lambda text: text)
    df = spark.createDataFrame([(1, 0, "user", "a [/INST] b"), (2, 0, "user", "plain")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.identical for r in chat_format.format_conversations(df).collect()} == {1: False, 2: True}


def test_chat_digests_read_the_mask(spark):
    said = "é [/INST] </s> [\\/INST] 𝔘"
    turns = [(1, 0, "user", "ask"), (1, 1, "assistant", said), (1, 2, "critic", "x </s>"), (1, 3, "assistant", "two"), (2, 0, "user", "alone")]
    whole = chat_format.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    read = lambda df: {r.conv_id: (r.loss_chars, r.loss_sha256) for r in chat_format.digests(df).collect()}
    sha = lambda text: (len(text), hashlib.sha256(text.encode()).hexdigest())
    assert read(whole) == {1: sha(said + "two"), 2: sha("")}
    moved = F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), (s["end"] + 1).alias("end")))
    assert read(whole.withColumn("loss_spans", moved))[1] == sha(said[1:] + " wo ")


def brute_revisit(v, responses):
    earlier = [r for r in responses if v["u"] and r["u"] == v["u"] and r["ts"] is not None and v["ts"] is not None and r["ts"] < v["ts"]]
    if not earlier:
        return "no-earlier-response", None
    r = max(earlier, key=lambda r: (r["ts"], r["id"]))
    if v["etag"] and r["etag"]:
        good = v["etag"].removeprefix("W/") == r["etag"].removeprefix("W/")
        return ("resolved", r["id"]) if good else ("etag-mismatch", None)
    if v["lm"] and r["lm"]:
        return ("resolved", r["id"]) if v["lm"] == r["lm"] else ("date-mismatch", None)
    return "no-validator", None


def test_revisits_against_brute_force(spark):
    random.seed(6)
    pick = random.choice
    rows = [{"id": k, "u": pick(["h/a", "h/b", "h/c", "h/a", None]), "ts": pick([None, *range(40)]), "kind": pick(["response", "revisit", "request"]), "etag": pick([None, '"x"', 'W/"x"', '"y"']), "lm": pick([None, "1", "2"])} for k in range(400)]
    url = lambda u: u and pick(["http://", "HTTPS://user@"]) + u.replace("h/", "H/") + pick(["", "#f", "?utm_source=x", "/"])
    df = spark.createDataFrame([(r["id"], url(r["u"]), r["ts"], r["kind"], r["etag"], r["lm"], "d", {"Content-Type": "t", "Date": str(r["id"])}) for r in rows], "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    responses = [r for r in rows if r["kind"] == "response"]
    for ranges in ("1", "30"):
        with_ranges(spark, ranges)
        found = {r.record_id: (r.status, r.response_id, r.headers) for r in warc.resolve_revisits(df).collect()}
        want = {v["id"]: brute_revisit(v, responses) for v in rows if v["kind"] == "revisit"}
        assert {k: v[:2] for k, v in found.items()} == want
        assert all(h == {"content-type": "t", "date": str(k)} for k, (s, _, h) in found.items() if s == "resolved")
    with_ranges(spark, "4")
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def with_ranges(spark, count):
    """Ranges of a scan: adaptive execution would join small ones."""
    spark.conf.set("spark.sql.shuffle.partitions", count)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(count == "4").lower())


@pytest.mark.parametrize("when", ["one early", "one instant"])
def test_a_hot_url_is_cut_by_rows(spark, monkeypatch, when):
    """One URL with all captures: neither a single early time nor a single time for all puts them into one range."""
    rows = 4000
    time_of = (lambda k: 0 if k == 0 else 10**9 + k) if when == "one early" else (lambda k: 7)
    df = spark.createDataFrame(
        [(k, "h/a", time_of(k), "response" if k % 3 == 0 else "revisit", '"x"', None, str(k), {}) for k in range(rows)],
        "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>",
    )
    kept = warc.Scratch.stored
    sizes = {}

    def watched(self, frame, name):
        out = kept(self, frame, name)
        sizes[name] = [r["count"] for r in out.groupBy("_part").count().collect()]
        return out

    monkeypatch.setattr(warc.Scratch, "stored", watched)
    with_ranges(spark, "8")
    found = {r.record_id: r.response_id for r in warc.resolve_revisits(df).collect()}
    with_ranges(spark, "4")
    assert max(sizes["captures"]) < rows / 3
    assert found == {k: k - k % 3 if when == "one early" else None for k in range(rows) if k % 3}


def test_canonical_urls(spark):
    urls = ["HTTP://Ex.org:80/a/?b=2&a=1&utm_x=3#f", "https://ex.org/a?a=1&b=2", "ex.org/a", None, ""]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.canonical_url(F.col("u"))).collect()]
    assert got == ["ex.org/a?a=1&b=2", "ex.org/a?a=1&b=2", "ex.org/a", None, ""]


def brute_segments(scores):
    """Maximal segments by their definition: recursively the best segment, then both sides of it."""
    best = None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-12 and (best is None or total > best[2] + 1e-12):
                best = (i, j + 1, total)
    if best is None:
        return []
    shift = [(a + best[1], b + best[1], s) for a, b, s in brute_segments(scores[best[1] :])]
    return [*brute_segments(scores[: best[0]]), best, *shift]


def test_maximal_segments():
    random.seed(2)
    for _ in range(200):
        gains = {k: random.choice([1.0, 2.5, 4.0]) + k / 1000 for k in range(30) if random.random() < 0.3}
        drift = 0.37
        dense = [gains.get(k, -drift) for k in range(30)]
        at = sorted(gains)
        got = toxicity.maximal_segments(at, [gains[k] for k in at], drift)
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in brute_segments(dense)]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(k, ("badword " if k % 2 else "") + f"plain text number {k}") for k in range(60)] + [(100, None), (101, ""), (None, "badword"), (1, "badword")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(100, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    out = {(r.doc_id, r.predicted) for r in toxicity.score(docs, model).collect()}
    assert {(k, k % 2) for k in range(60)} | {(100, 0), (101, 0), (None, 1)} <= out
    empty = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert toxicity.score(docs, empty).where("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_quality_edges(spark):
    docs = spark.createDataFrame([(k, f"good words stand here and there in order {k}" if k % 2 else f"BAD!! BAD!! BAD!! {k}") for k in range(80)] + [(100, None), (101, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    out = quality.score(docs, model).collect()
    assert len(out) == 83 and all(r.predicted == r.doc_id % 2 for r in out if r.doc_id is not None and r.doc_id < 80)
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0), F.lit(True))).collect()} == {0.5}


def plain_scores(x, y, bins, rounds, rate, leaves, ridge, least):
    """Cyclic boosting by loops: for each feature a tree grown split by split over its bins, added to its table."""
    base = min(max(sum(y) / len(y), 0.01), 0.99)
    score = [math.log(base / (1 - base))] * len(x)
    width = len(x[0])
    cuts = []
    for k in range(width):
        values = sorted({r[k] for r in x})
        if len(values) > bins:
            values = sorted(set(np.quantile([r[k] for r in x], np.linspace(0, 1, bins + 1)).tolist()))
        cuts.append([(a + b) / 2 for a, b in zip(values, values[1:])])
    place = [[sum(r[k] >= c for c in cuts[k]) for k in range(width)] for r in x]
    for _ in range(rounds):
        for k in range(width):
            g, h = [0.0] * (len(cuts[k]) + 1), [0.0] * (len(cuts[k]) + 1)
            for i, p in enumerate(place):
                chance = 1 / (1 + math.exp(-score[i]))
                g[p[k]] += y[i] - chance
                h[p[k]] += chance * (1 - chance)
            parts = [(0, len(g))]
            while len(parts) < leaves:
                best = None
                for a, b in parts:
                    for c in range(a + 1, b):
                        left, right = (sum(g[a:c]), sum(h[a:c])), (sum(g[c:b]), sum(h[c:b]))
                        if min(left[1], right[1]) < least:
                            continue
                        both = (left[0] + right[0], left[1] + right[1])
                        gain = sum(s * (u * u / (v + ridge)) for s, (u, v) in ((1, left), (1, right), (-1, both)))
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, a, b, c)
                if best is None:
                    break
                parts.remove(best[1:3])
                parts += [(best[1], best[3]), (best[3], best[2])]
            for a, b in parts:
                step = rate * max(-4.0, min(4.0, sum(g[a:b]) / (sum(h[a:b]) + ridge)))
                for i, p in enumerate(place):
                    if a <= p[k] < b:
                        score[i] += step
    return [1 / (1 + math.exp(-s)) for s in score]


def test_additive_model_against_plain_boosting():
    rng = np.random.default_rng(5)
    x = np.round(rng.random((120, 3)), 2)
    y = (x[:, 0] + 0.3 * rng.random(120) > 0.6).astype(float)
    model = quality.train(x, y, bins=8, rounds=6, pair_rounds=0, n_pairs=0)
    want = plain_scores(x.tolist(), y.tolist(), 8, 6, 0.15, 4, 1.0, 0.5)
    assert np.allclose(model.score(x), want, atol=1e-9)


def test_quality_query_scores_are_the_tables_sums(spark):
    """op1 over its whole table: each score is the sum of the entries that its features look up, one by one."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    fold = F.pmod(fold_crc(F.col("doc_id")), F.lit(3))
    model = quality.fit(docs, labels, fold != 1)
    found = {r.doc_id: r.score for r in op1_quality(spark, DATA).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for doc_id, text in rows:
        x, total = quality.features(text), model.intercept
        for value, edges, entries in zip(x, model.edges, model.tables):
            total += entries[sum(bool(value >= e) for e in edges)]
        for (i, j), entries in zip(model.pairs, model.pair_tables):
            total += entries[sum(bool(x[i] >= e) for e in model.pair_edges[i]), sum(bool(x[j] >= e) for e in model.pair_edges[j])]
        assert abs(found[doc_id] - 1 / (1 + math.exp(-max(-60, min(60, total))))) < 1e-9


def test_training_rows_are_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, "toxic", F.lit(True), 10).collect()
    assert sorted((r.text[:4], r.y) for r in rows) == [("b", 0), ("text", 1)]


def test_scores_beside_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "x", 5, 6, "p")], "doc_id long, text string, score int, predicted int, passages string")
    out = toxicity.score(docs, toxicity.ToxicModel(), keep=docs.columns)
    assert out.columns == ["doc_id", "text", "score", "predicted", "passages"] and out.where("predicted = 0").count() == 1


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality.train(x, y, rounds=20)
    assert (0, 2) in model.pairs and ((model.score(x) > 0.5) == (y > 0)).mean() > 0.95


@pytest.mark.parametrize("text", [None, "", " ", "\n" * 5, "é" * 10])
def test_features_are_finite(text):
    assert np.isfinite(quality.features(text)).all()
