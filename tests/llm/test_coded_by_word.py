"""Which tokenizer files code words one by one, told from the files; others are coded as whole texts."""

import copy
import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest_rows import messy_rows

from scriptorium.llm import tokenfile
from scriptorium.llm.arrays import column_bytes


@pytest.fixture(scope="module")
def told():
    return json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_of_files(told):
    assert tokenfile.codes_by_word(told)
    assert not tokenfile.codes_by_word(json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()))
    changes = [("normalizer", {"type": "Prepend", "prepend": "x"}), ("normalizer", {"type": "Replace", "pattern": {"String": "a b"}, "content": "c"}), ("pre_tokenizer", None), ("pre_tokenizer", {"type": "Metaspace", "replacement": "_", "prepend_scheme": "always"}), ("post_processor", {"type": "Other"})]
    for key, value in changes:
        assert not tokenfile.codes_by_word({**told, key: value}), key
    token = copy.deepcopy(told)
    token["added_tokens"][0]["lstrip"] = True
    assert not tokenfile.codes_by_word(token)
    token = copy.deepcopy(told)
    token["added_tokens"].append(token["added_tokens"][0] | {"content": "the end", "id": 50_000})
    assert not tokenfile.codes_by_word(token)


@pytest.mark.parametrize("change", [None, "a token with a blank"])
def test_ids_are_the_librarys(told, tmp_path, change):
    from tokenizers import Tokenizer

    made = copy.deepcopy(told)
    if change:
        made["added_tokens"].append(made["added_tokens"][0] | {"content": "an ba", "id": 49_408})
    path = tmp_path / "made.json"
    path.write_text(json.dumps(made))
    tokenizer = Tokenizer.from_file(str(path))
    texts = [t or "" for _, t in messy_rows() if len(t or "") < 50_000] + ["an ba an ba", "x an\nba"]
    flat, at = tokenfile.encode_chunk(str(path), *column_bytes(pa.array(texts)))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want
    assert (at[-1], len(flat)) == (sum(map(len, want)),) * 2 and flat.dtype == np.int32
