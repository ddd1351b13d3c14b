"""A batch of questions gives out all that it makes: context, prompt and sources beside the flag and the counts."""

import json

import __spark_entry__ as E


def test_batch_gives_out_context_prompt_and_sources(spark, tmp_path):
    tables = {
        "part": ([(1, "green kettle", "KITCHEN", "Brand#1", 3), (2, "red lamp", "HOME", "Brand#2", 3)],
                 "p_partkey long, p_name string, p_type string, p_brand string, p_size int"),
        "lineitem": ([(7, 1, 1, 1, 200.0, 0.05), (8, 2, 1, 1, 90.0, 0.02)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double"),
        "documents": ([(1, "green kettle"), (2, "red lamp")], "doc_id long, text string"),
        "conversations": ([("c", 0, "user", "product green kettle 1 category kitchen description green kettle reviews green kettle"),
                           ("c", 1, "assistant", "yes"), ("c", 2, "user", "zzz")],
                          "conv_id string, turn int, role string, text string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["query_id"]: r for r in E.queries()["rag_batch"](spark, str(tmp_path)).collect()}
    assert set(got) == {"c-0", "c-2"}
    hit, none = got["c-0"], got["c-2"]
    assert hit["grounded"] and hit["n_hits"] == 1 and "green kettle #1" in hit["context"]
    assert hit["context"] in hit["prompt"] and hit["question"] in hit["prompt"] and "Example Question" in hit["prompt"]
    source, = json.loads(hit["sources"])
    assert source == {"product": "green kettle #1", "relevance": source["relevance"], "id": "1"} and 0.5 <= source["relevance"] <= 1
    assert not none["grounded"] and none["sources"] == "[]" and none["prompt"].startswith("User Question: zzz")
