import json

from skyweave.llm import chat


def test_records_with_further_keys_and_empty_lists(spark):
    turns = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]
    records = [{"messages": turns, "id": 3}, {"prompt": "hi", "completion": "yo", "source": "a"}, {"instruction": "hi", "input": "", "output": "yo", "weight": 0.5}, {"messages": []}, {"messages": [], "id": 1}, {"prompt": "hi", "id": 2}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id long, record string")
    got = {r.id: r.formatted for r in chat.format_json(df, "record").collect()}
    want = "<turn - user>hi</turn>\n<turn + assistant>yo</turn>\n"
    assert [got[i] for i in range(6)] == [want, want, want, "", "", None]
