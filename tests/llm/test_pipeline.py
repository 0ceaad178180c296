import random

import corpus_pipeline as c
import public_tokenizers
from tokenizers import Tokenizer

from tierline.llm.common import scratch_dir
from tierline.llm.queries import ORACLES, QUERIES

SYLLABLES = {"aa": ["the", "and", "ing", "tion"], "bb": ["der", "und", "sch", "ung"]}


def test_stages_against_plain_steps(spark):
    rng = random.Random(1)
    text = lambda lang, n: " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(lang := rng.choice(["aa", "bb"]), 80), lang) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail", rows[i][2]) for i in range(5)] + [(105, rows[7][1], "aa")]
    item = text("aa", 30)
    rows += [(200, text("aa", 40) + " " + " ".join(item.split()[5:20]), "aa"), (201, text("aa", 40) + " token=abcdefgh12 end", "aa")]
    rows += [(300, None, None), (301, "123", None), (302, "漢字" * 50, None)]
    folder = scratch_dir(spark, "pipeline-input")
    docs = spark.createDataFrame([(i, t, lang, "s", t and len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r.doc_id: r for r in c.run(spark, folder).collect()}
    assert set(got) == set(range(60)) | {201}
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t, _ in rows:
        if i in got:
            want = whole.encode(t.replace("token=abcdefgh12", "[secret]"), add_special_tokens=False).ids
            assert list(got[i].ids) == want
    stored = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, stored, folder)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name


def test_registry():
    assert [n for n, _ in c.STAGES] == ["language", "near_dedup", "decontaminate", "secrets", "bpe"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
