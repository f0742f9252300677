import hashlib
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import numpy as np
import public_tokenizers
import test_decontam
import test_simhash
import test_substring
from tokenizers import Tokenizer

import corpus_pipeline
from memlake.llm import toxicity


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    say = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    passage, leak = say(60), say(15)
    rows = []
    for i in range(120):
        t = say(r.randrange(5, 120))
        t += f" {passage}" if i % 9 == 0 else f"\n{leak}" if i % 13 == 0 else " villain knave villain" if i % 4 == 0 else ""
        rows.append((i, t, "en", "s", len(t)))
    rows += [(200 + i, rows[i][1], "en", "t", rows[i][4]) for i in range(0, 30, 2)] + [(300, None, None, None, None), (301, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    toxic = [(i, 1, int("villain" in (t or ""))) for i, t, *_ in rows]
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, leak), (2, "nothing of this kind is in any document of the table at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    got = {x.doc_id: tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = toxicity.train(toxicity.training_rows(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    left = [(i, t) for (i, t, *_), s in zip(rows, model.score_all([x[1] or "" for x in rows]), strict=True) if s < 0.3]
    assert len(left) < len(rows) and {i for i, t in left} >= {i for i, t, *_ in rows if "villain" not in (t or "")}
    kept = {d for d, _, c in test_simhash.brute(left) if d == c}
    left = [x for x in left if x[0] in kept]
    hashed = {d: (n, h) for d, _, n, h in test_substring.brute(left)}
    new = []
    for i, t in left:
        if hashed[i][0]:
            w = test_substring.WORD.findall(t)
            count = {d: 0 for d in range(len(w))}
            for j in range(len(w) - 34):
                if sum(" ".join(w[j : j + 35]) in " ".join(test_substring.WORD.findall(o or "")) for _, o in left) > 1:
                    for k in range(j, j + 35):
                        count[k] = 1
            t = " ".join(x for k, x in enumerate(w) if not count[k])
            assert hashlib.sha256(t.encode()).hexdigest() == hashed[i][1]
        new.append((i, t))
    bad = {d for d, _, _, _, _, c in test_decontam.brute(new, items) if c}
    assert bad
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in new:
        if i not in bad:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            want[i] = (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert got == want


def test_stages_keep_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [tuple(x) for x in out.collect()] == [(1, "a b c", "en", "s", 5)]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Extra columns, null ids and texts, repeated rows: nothing is lost, renamed or overwritten."""
    extra = ["score", "_score", "n_words", "n_removed", "factors", "_kept_text", "_row", "_kept", "_id", "_of", "_key", "_spans", "_matches", "key", "root", "fp", "rank", "_host", "_rank", "_TIMES"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in extra)
    row = lambda i, t: (i, t, "en", "s", 7, *range(len(extra)))
    passage, leak = " ".join(f"p{i}" for i in range(40)), " ".join(f"q{i}" for i in range(12))
    rows = [row(1, f"one two three {passage} four"), row(2, f"{passage} five six seven eight"), row(3, leak), row(None, None), row(None, "lone words of a kind"), row(4, "again and again and"), row(4, "again and again and")]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {"toxicity": 7, "simhash_near_dedup": 6, "substring_dedup": 6, "benchmark_decontamination": 5}
    for name, f in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, f(spark, docs, str(tmp_path))
        got = docs.collect()
        assert docs.columns == before.columns and len(got) == want[name], name
        assert all(tuple(x)[5:] == tuple(range(len(extra))) for x in got), name
    left = sorted((x.doc_id or 0, x.text, x.n_chars) for x in got if x.text)
    assert left == [(0, "lone words of a kind", 7), (1, "one two three four", 18), (2, "five six seven eight", 20), (4, "again and again and", 7)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 5


def test_tables_of_finished_stages_are_deleted(spark, tmp_path):
    import os

    from memlake.llm import common

    common.cleanup(spark)
    docs = spark.createDataFrame([(i, f"some text of number {i}", "en", "s", 9) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert len(common.written()) == 1 and out.count() > 0
    common.cleanup(spark)
    assert not common.written() and not [x for x in os.listdir(spark.conf.get("spark.checkpoint.dir")) if x.startswith("stage-")]
