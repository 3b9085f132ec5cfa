import hashlib
import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as P

from .test_jaccard_rtree import brute as brute_groups
from .test_secret_crf import base as secret_spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(25)
    good = [prose(rng.randrange(60, 150)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(200, good[3]), (201, good[4] + " extra"), (202, prose(40) + " " + item + " " + prose(40)), (203, "short"), (204, None), (205, "spam " * 100),
             (206, prose(80).upper()), (207, prose(70) + ' token = "aB3dE5gH7jK9mN2pQ4" ' + prose(10)), (207, prose(60))]
    docs = spark.createDataFrame([(i, t, ["en", None][(i or 0) % 2], "s", None if t is None else len(t)) for i, t in rows], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in P.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append(sorted(r.doc_id for r in kept.select("doc_id").collect()))
        if name != P.STAGES[-1][0]:
            assert kept.columns == docs.columns
    assert [len(P.STAGES), *(len(i) for i in ids)] == [5, len(rows) - 4, len(rows) - 6, len(rows) - 7, len(rows) - 7, len(rows) - 7]
    assert set(range(120)) | {207} == set(ids[-1])

    clean = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/secrets").collect()]
    assert not any(secret_spans(t) for _, t in clean) and any("[secret]" in t for _, t in clean)
    assert len({c for _, _, c in brute_groups(clean)}) == len({i for i, _ in clean})
    real = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i, hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest()) for i, t in clean for x in [real.encode(t, add_special_tokens=False).ids])
    assert sorted((r.doc_id, r.ids_sha256) for r in P.run(spark, str(tmp_path)).collect()) == want


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
