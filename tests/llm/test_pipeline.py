"""The pipeline against a plain version of its stages."""

import duckdb
import numpy as np

import corpus_pipeline
from freshet.llm import curriculum, decontaminate, huffman, language, near_dedup, tokens


def test_stages(spark, data, documents):
    docs = {r["doc_id"]: r for r in documents.collect()}
    net = language.fit(documents)
    found = {r["doc_id"]: r for r in language.predict(documents, net).collect()}
    kept = {k for k in docs if found[k]["lang_pred"] != "und" and found[k]["score"] >= corpus_pipeline.LEAST_SCORE}
    assert len(kept) > 0.95 * len(docs)

    def rows(ids, sql, name):
        con = duckdb.connect()
        con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
        con.executemany("insert into documents values (?, ?, ?)", [(k, docs[k]["text"], docs[k]["source"]) for k in sorted(ids)])
        con.execute(f"create view benchmark as select * from read_parquet('{data}/benchmark.parquet')")
        con.execute(sql)
        names = [d[0] for d in con.description]
        return [dict(zip(names, r, strict=True)) for r in con.fetchall()]

    kept = {r["doc_id"] for r in rows(kept, near_dedup.ORACLES["op8_minhash_near_dedup"], "near") if r["kept"]}
    kept = {r["doc_id"] for r in rows(kept, decontaminate.ORACLES["op10_simhash_decontamination"], "leaks") if not r["contaminated"]}
    copies = {r["doc_id"]: r["copies"] for r in rows(kept, curriculum.ORACLES["op9_curriculum_mixing"], "mix")}
    library, want, start = tokens.load(tokens.default_path()), [], 0
    for k in sorted(copies):
        n = len(library.encode(docs[k]["text"], add_special_tokens=False).ids) + 1
        for _ in range(copies[k]):
            want.append((k, start, n))
            start += n
    got = corpus_pipeline.run(spark, data)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in got.collect()) == want
    assert np.isfinite(start) and huffman.END_ID == 2


def test_odd_rows_pass_every_stage(spark, data, odd, nothing):
    for docs in (odd, nothing):
        frame = docs
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, data)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert frame.columns == list(corpus_pipeline.COLUMNS)
        frame.collect()
