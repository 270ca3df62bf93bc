import random

import corpus_pipeline
from tallyframe.llm import decontaminate, langid, pieces, secrets

from .conftest import prose
from .test_simhash import classes, plain_fp


def test_pipeline_equals_plain_python(spark, tmp_path):
    rng = random.Random(12)
    items = [(i, prose(rng, 30)) for i in range(4)]
    texts = [prose(rng, 60) for _ in range(30)]
    texts[5] = texts[1]
    texts[6] = texts[2] + " ."
    texts[7] = items[0][1] + " more"
    texts[8] += ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'
    texts[9], texts[10], texts[11] = None, "", "123 !!"
    docs = [(i, t, "en" if i % 2 else "xx", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labeller = langid.Labeller(langid.train(table))
    kept = [i for i, x in enumerate(labeller.judge(texts)) if x[0] != "und" and x[1] >= corpus_pipeline.LEAST_SCORE]
    assert not {9, 10, 11} & set(kept)
    label = classes([plain_fp(texts[i]) for i in kept])
    kept = [i for k, i in enumerate(kept) if label[k] == k]
    assert 5 not in kept
    found = decontaminate.Searcher([(str(i), t.encode()) for i, t in items]).search([texts[i].encode() for i in kept])
    kept = [i for i, (n, hit, _) in zip(kept, found, strict=True) if not hit or 20 * len(hit) < n]
    assert 7 not in kept and len(kept) > 15
    count = secrets.encoder(secrets._ranks(None))
    want = {}
    sampler = pieces.Sampler(pieces.Vocabulary())
    for i in kept:
        t = texts[i]
        for s, _, e in reversed(secrets.find(t, count)):
            if i == 8 and s != secrets.find(t, count)[0][0]:
                continue  # the digest lies within the assignment
            t = t[:s] + "[secret]" + t[e:]
        want[i] = sampler.encode([t.encode()], [i])[0].tolist()
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r.ids for i, r in got.items()} == want
    assert 8 not in want or "[secret]" in pieces.decoded(sampler.vocabulary.raw, want[8]).decode()


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
