"""The pipeline and its stages on small fixtures, against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_joins import jaccard_links, roots
from test_text_operators import brute_overlap

import corpus_pipeline
from quillspark.llm import packing, stages, toxicity
from quillspark.llm.common import fold_crc
from quillspark.llm.queries import tokenizer_path

BLANKS = " \t\n\x0b\x0c\r"


def test_near_copies_go_by_id_and_text(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v"), (2, None), (None, "a b c d e f"), (3, ""), (4, "Q r s t u v"), (1, "k l m n o p")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, n_chars long")
    kept = stages.keep_one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert found == sorted([(1, "a b c d e f"), (2, "q r s t u v"), (2, None), (None, "a b c d e f"), (3, ""), (1, "k l m n o p")], key=repr)


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "a b c d e f", "z"), (5, "g h i j k l", "x"), (5, "g h i j k l", "y"), (5, "other words stand here", "z"), (6, None, "x"), (6, None, "x")]
    kept = stages.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string, mark string"), "").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == {(1, "a b c d e f"): 1, (5, "g h i j k l"): 1, (5, "other words stand here"): 1, (6, None): 2}


def corpus():
    random.seed(21)
    vocabulary = [f"w{k}" for k in range(400)]
    line = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    docs = [(k, "\n".join(line(random.randint(4, 14)) for _ in range(random.randint(1, 5)))) for k in range(160)]
    docs += [(200 + k, "slurA slurB you slurC " + line(6) + " slurA slurC") for k in range(40)]
    common = "this very line stands on many pages"
    docs += [(300 + k, f"{line(9)}\n {common.upper() if k % 2 else common} \n{line(7)}") for k in range(12)]
    long = [random.choice(vocabulary) for _ in range(60)]
    docs += [(400 + k, " ".join([*long[: 50 - k], "changed", *long[51 - k :]])) for k in range(5)]
    docs += [(410, docs[3][1]), (411, docs[3][1] + "!"), (412, docs[3][1])]
    benchmark = [(k, line(12)) for k in range(6)]
    docs += [(500 + k, f"{line(5)} {benchmark[k][1]} {line(5)}") for k in range(3)]
    docs += [(510, "one two"), (600, None), (601, ""), (602, "?!"), (None, "no id, but words of its own"), (None, None), (5, "a second text under one id"), (700, "long " * 30_000)]
    benchmark += [(90, "one two"), (91, None), (92, "")]
    labels = [(d, 1, int(200 <= d < 300)) for d, _ in docs if d is not None and d < 300]
    return docs, benchmark, labels


def plain_lines(docs):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BLANKS))
    owners = {}
    for d, t in docs:
        for x in (t or "").split("\n") if d is not None else []:
            owners[key(x)] = min(d, owners.get(key(x), d))
    lines = lambda d, t: "\n".join(x for x in t.split("\n") if d is None or len(key(x)) < 10 or owners[key(x)] == d)
    return [(d, None if t is None else lines(d, t)) for d, t in docs]


def plain_groups(docs):
    able = [(k, t) for k, (d, t) in enumerate(docs) if d is not None]
    of = roots([k for k, _ in able], jaccard_links(able))
    groups = defaultdict(list)
    for k, root in of.items():
        groups[root].append(k)
    stay = {min(own, key=lambda k: docs[k][0]) for own in groups.values()}
    return [r for k, r in enumerate(docs) if r[0] is None or k in stay]


def plain_leaks(docs, benchmark):
    def clean(text):
        _, _, items = brute_overlap(text, benchmark)
        runs, words = set(), brute_hits(text, benchmark)
        for k in words:
            runs.add(sum(1 for _ in takewhile_up(words, k)))
        return len(items) < 2 and max(runs, default=0) < 8

    return [r for r in docs if clean(r[1])]


def takewhile_up(words, k):
    while k in words:
        yield k
        k += 1


def brute_hits(text, benchmark):
    from quillspark.llm.common import words_of

    words, hit = words_of(text), set()
    for _, body in benchmark:
        w = words_of(body)
        k = min(8, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == w[i : i + k]:
                    hit.update(range(j, j + k))
    return hit


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs, benchmark, labels = corpus()
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def shown(rows):
    return sorted(rows, key=repr)


def test_pipeline_against_plain_stages(spark, tables):
    docs, benchmark, _ = corpus()
    read = lambda n: spark.read.parquet(f"{tables}/{n}.parquet")
    model = toxicity.fit(read("documents"), read("labels"), F.pmod(fold_crc(F.col("doc_id")), F.lit(4)) != 2)
    want = [docs]
    want.append([(d, t) for d, t in want[-1] if model.score(model.segments(t)[1]) < 0.3])
    want.append(plain_lines(want[-1]))
    want.append(plain_groups(want[-1]))
    want.append(plain_leaks(want[-1], benchmark))
    assert len(want[1]) == len(docs) - 40 and len(want[3]) < len(want[2]) and len(want[4]) == len(want[3]) - 3
    frame = read("documents")
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:4], want[1:]):
        frame = stage(spark, frame, tables)
        frame = spark.createDataFrame(frame.collect(), read("documents").schema)
        assert frame.columns == read("documents").columns
        assert shown((r.doc_id, r.text) for r in frame.collect()) == shown(rows), name
        assert all(r.n_chars == len(r.text or "") for r in frame.collect())
    found = defaultdict(list)
    for r in corpus_pipeline.run(spark, tables).collect():
        found[r.doc_id].append((r.start, list(r.ids)))
    library = packing.tokenizer(tokenizer_path("byte_bpe_50k.json")).library
    packed = defaultdict(list)
    for d, t in want[4]:
        packed[d] += [*library.encode(t or "", add_special_tokens=False).ids, 1]
    assert {d: sum(len(i) for _, i in own) for d, own in found.items()} == {d: len(i) for d, i in packed.items()}
    single = {d for d, n in Counter(d for d, _ in want[4]).items() if n == 1}
    assert all(np.concatenate([i for _, i in sorted(own)]).tolist() == packed[d] for d, own in found.items() if d in single)


def test_stages_take_empty_tables_and_any_columns(spark, tables):
    names = ["score", "text", "predicted", "kept_text", "doc_id", "n_lines", "_lines", "rest", "h1", "mark", "a b", "_said", "_"]
    kind = {"text": "string", "doc_id": "long"}
    schema = ", ".join(f"`{n}` {kind.get(n, 'int')}" for n in names)
    values = lambda d, t: tuple(t if n == "text" else d if n == "doc_id" else 7 for n in names)
    docs = spark.createDataFrame([values(1, "a line that is shared\nalpha beta gamma delta epsilon"), values(2, "a line that is shared\nother"), values(2, "a line that is shared\nother"), values(3, None)], schema)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, tables)
        assert out.columns == names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.count() >= 3 and all(r.score == 7 for r in out.collect())
        assert stage(spark, docs.limit(0), tables).count() == 0
    assert stages.pack(spark, docs.limit(0), tables).count() == 0
    assert {r.doc_id for r in stages.pack(spark, docs, tables).collect()} == {1, 2, 3}
