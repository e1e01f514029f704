import hashlib

import corpus_pipeline
from sparkprep.llm import langid, mixing, simhash

SF = "/root/testdata/sf0.001"


def test_stages_on_odd_documents(spark, clashing, none, tmp_path):
    docs = clashing
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    assert docs.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_run_against_the_operators(spark, small):
    got = corpus_pipeline.run(spark, SF).collect()
    kept = small.where("text IS NOT NULL")
    named = {r.doc_id: r.component_id for r in simhash.groups_of(kept).collect()}
    preds = {r.doc_id: r for r in langid.languages(small).collect()}
    firsts = {c for c in named.values() if preds[c].lang_pred != "und" and preds[c].score >= corpus_pipeline.LEAST_SCORE}
    assert {r.doc_id for r in got} <= firsts
    assert len(firsts - {r.doc_id for r in got}) < 0.5 * len(firsts)  # the mix leaves some out
    counts = {}
    for r in got:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) == int(mixing.MOST)
    texts = {r.doc_id: r.text for r in small.collect()}
    same = [r for r in got if "@" not in texts[r.doc_id] and not any(c.isdigit() for c in texts[r.doc_id])]
    assert same and all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in same)
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_language_stage_rejects_unlearned_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    unlearned = [
        "Wczoraj wieczorem w naszym mieście odbyło się spotkanie mieszkańców z burmistrzem.",
        "Eilen illalla kaupungissamme pidettiin asukkaiden kokous.",
        "Dün akşam şehrimizde belediye başkanı ile bir toplantı yapıldı.",
        "Gisteravond vond er in onze stad een bijeenkomst plaats met de burgemeester.",
        "Вчера вечером в нашем городе состоялась встреча жителей. " * 40,
        "昨天晚上在我们的城市举行了居民会议",
        "xq zkvw bnmtr qwpfg zxcvb hjklp wqrtz",
        "12 345 --- 67 Привет 8 9 ... " * 9,
    ]
    clean = [(r.lang, " ".join(r.text.split()[3:9])) for r in docs.where("n_chars > 200").orderBy("doc_id").limit(200).collect()]
    clean = [t for _, t in clean if all(c.isalpha() or c in " .," for c in t)]
    assert len(clean) > 100
    rows = [(-1 - i, t, None, "x", len(t)) for i, t in enumerate(unlearned + clean)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language(spark, docs.select(*more.columns).unionByName(more), SF)
    ids = {r.doc_id for r in kept.where("doc_id < 0").collect()}
    assert not ids & {-1 - i for i in range(len(unlearned))}
    assert len(ids) >= 0.99 * len(clean)
    assert kept.where("doc_id >= 0").count() >= 0.99 * docs.count()
