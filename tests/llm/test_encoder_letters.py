"""New words of letters reach the library without an object of their own; words that hold an added token don't go that way."""

import json
import random

import numpy as np
from tokenizers import Tokenizer

from tickloom.llm import token_output


def test_end_to_end_gathers_spans():
    b = np.frombuffer(b" ab cd  ef", np.uint8)
    assert token_output._end_to_end(b, np.array([0, 7, 3]), np.array([3, 10, 6])).tobytes() == b" ab ef cd"
    assert len(token_output._end_to_end(b, np.zeros(0, int), np.zeros(0, int))) == 0


def test_added_tokens_of_letters_inside_words(tmp_path):
    told = json.loads(Tokenizer.from_file(token_output.default_tokenizer()).to_str())
    told["added_tokens"] = [*told["added_tokens"], {"id": 50_000 + len(told["added_tokens"]), "content": "zqx", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]
    at = str(tmp_path / "tokenizer.json")
    with open(at, "w") as f:
        json.dump(told, f)
    whole, encoder = Tokenizer.from_file(at), token_output.Encoder(at)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abzqxé") for _ in range(rng.randrange(1, 12))) + rng.choice(["", "", ",", "7", "zqx"]) for _ in range(60)) for _ in range(40)]
    rows = [t.encode() for t in texts]
    ids, first = encoder.encode(np.frombuffer(b"".join(rows), np.uint8), np.r_[0, np.cumsum([len(r) for r in rows])])
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == [*whole.encode(t, add_special_tokens=False).ids, token_output.END_ID]
