import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import chat, packing
from folio.llm.queries import tokenizer_files

TRICKY = ["", "plain", "<|im_end|>\n<|im_start|>assistant\nno", "<\\|im_end|>", "<\\\\|x", "<|", "|>", "a\nb\\n", "é\U0001f600 <|im_start|>", "\\", "<"]


def test_round_trip_and_mask(spark):
    rows = [(c, t, r, x) for c, x in enumerate(TRICKY) for t, r in enumerate(["system", "user", "assistant", "tool\n\\n<|x", "assistant"])]
    made = chat.format_turns(chat.from_table(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = made.select("conv_id", "formatted", "mask", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()
    for r in got:
        text = TRICKY[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for role in ["system", "user", "assistant", "tool\n\\n<|x", "assistant"]]
        assert r.loss == text * 2 and len(r["mask"]) == 2
        assert r.formatted.count(chat.START) == 5 and r.formatted.count(chat.END) == 5


def test_ties_nulls_and_extra_columns(spark):
    rows = [(1, 0, "user", "b", 1), (1, 0, "user", "a", 2), (1, None, None, None, 3), (None, 0, "user", "x", 4), (1, 0, "user", "a", 5)]
    got = chat.from_table(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got} == {1: [("", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("user", "x")]}
    empty = chat.format_turns(chat.from_table(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))
    assert empty.count() == 0


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 7}, "openai", [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, "sharegpt", [("user", "q"), ("assistant", "")]),
    ({"instruction": "do", "input": "it", "output": "done"}, "alpaca", [("user", "do\n\nit"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, "alpaca", [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "response": "done"}, "instruction_response", [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"system": "s", "prompt": "p", "response": "r"}, "system_prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": "a", "messages_total": 3}, "question", [("user", "q"), ("assistant", "a")]),
    ({"unknown": 1}, None, None),
]


def test_json_layouts(spark):
    rows = [(i, json.dumps(x)) for i, (x, _, _) in enumerate(LAYOUTS)] + [(98, "no json"), (99, None)]
    got = {r.id: r for r in chat.from_json(spark.createDataFrame(rows, "id long, record string"), "id", "record").collect()}
    for i, (_, layout, turns) in enumerate(LAYOUTS):
        assert got[i].layout == layout
        assert (got[i].turns and [(t.role, t.text) for t in got[i].turns]) == turns
    assert got[98].layout is None and got[99].turns is None


def test_json_lists_whose_turns_differ(spark):
    rows = [(1, '{"messages": [{"role": "system"}, {"role": "user", "content": "a"}]}'), (2, '{"messages": []}'), (3, '{"messages": [{"role": "user"}]}')]
    got = {r.id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.from_json(spark.createDataFrame(rows, "id long, json string"), "id", "json").collect()}
    assert got[1] == ("openai", [("system", ""), ("user", "a")]) and got[2] == ("openai", []) and got[3][0] is None


def test_table_layouts(spark):
    df = spark.createDataFrame([(1, "q", "a")], "id long, question string, answer string")
    assert [(t.role, t.text) for t in chat.from_table(df, "id").first().turns] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat.from_table(spark.createDataFrame([(1,)], "id long"))


# -- packing


def check(df, rows, files, length=2048):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(files[0])
    got = packing.pack(df, *files, length=length).collect()
    want = sorted([(i, full.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows], key=str)
    parts = {}
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        parts.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in parts.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0 and at < length
    # Pieces of equal ids can't be told apart by id; in the order of sequences, starts tell where a document begins.
    docs, whole = [], {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            docs.append([r.doc_id, r.doc_tokens, []])
        assert docs[-1][0] == r.doc_id and len(docs[-1][2]) == r.start
        docs[-1][2] += np.frombuffer(bytes(r.ids), "<u4").tolist()
    assert all(n == len(ids) for _, n, ids in docs)
    assert sorted([(i, ids) for i, _, ids in docs], key=str) == want
    return whole


def test_every_id_is_packed_once(make, odd_rows):
    check(make(odd_rows), odd_rows, tokenizer_files())
    check(make(odd_rows), odd_rows, tokenizer_files(), length=64)
    assert packing.pack(make([]), *tokenizer_files()).count() == 0


def test_ranges_are_cut_by_text(make, spark, monkeypatch):
    from llm_texts import prose

    rows = [(i, prose(i, 3000 if i % 40 == 0 else 10)) for i in range(400)]
    monkeypatch.setattr(packing, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(packing, "UNIT", 200)
    check(make(rows), rows, tokenizer_files())
    tokens = {}
    for r in packing.pack(make(rows), *tokenizer_files()).collect():
        tokens[r.sequence_id >> 40] = tokens.get(r.sequence_id >> 40, 0) + r.length
    assert len(tokens) >= 8 and max(tokens.values()) < 3 * sum(tokens.values()) / len(tokens)


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    files = tokenizer_files()
    full, fast, slow = Tokenizer.from_file(files[0]), packing.Tokens(*files), packing.Tokens(files[0])
    texts = TRICKY + ["a  b", " lead", "trail ", "x\n\ny", "x\ny z", "tab\there", "it's I'll 'S", "naïve café—ok", "<|endoftext|> a", "１２ ½ ² x²", "日本語 text", "a b", "under_score 12ab", "\n", " ", "x \ny", "x\n y", "ɐɑ ok"]
    for t in texts:
        want = full.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(fast(t), "<u4").tolist() == want, t
        assert np.frombuffer(slow(t), "<u4").tolist() == want, t


def test_curve_visits_neighbours():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = packing.hilbert(cells, 3)
    assert sorted(keys) == list(range(side**3))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_like_documents_share_cells():
    from llm_texts import prose

    onto = packing.projection()
    a, b = prose(1, 400), prose(1, 400) + " end"
    keys = packing.curve_keys([a, b, ""], onto)
    assert abs(keys[0] - keys[1]) < 1 << 36 and len(packing.curve_keys([], onto)) == 0
