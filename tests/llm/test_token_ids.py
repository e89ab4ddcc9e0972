"""Ids of many texts at once equal those of each text by the tokenizer."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from maskwright.llm import token_ids as ti

ODD = ["\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", " ", "　"]


def _texts():
    rng = random.Random(5)
    signs = ["a", "Word", "it's", "42", "é", "ß", "漢", "...", "\x00", "​", "</w>", "[UNK]", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(300)]
    texts += ["a" + o + "b c" for o in ODD] + [" ", "", " lead", "trail ", "\n\n"]
    return [None if i % 41 == 7 else t for i, t in enumerate(texts)]


def test_many_texts_at_once(monkeypatch):
    path = public_tokenizers.path(ti.VOCABULARY)
    plain, encoder, texts = Tokenizer.from_file(path), ti.WordEncoder(path), _texts()
    wanted = [[*(plain.encode(t, add_special_tokens=False).ids if t else []), ti.END] for t in texts]
    whole = pa.array(texts, pa.string())
    assert [x.tolist() for x in encoder.documents(whole)] == wanted
    assert [x.tolist() for x in encoder.documents(whole.slice(250))] == wanted[250:]
    monkeypatch.setattr(ti, "AT_ONCE", 50)
    assert [x.tolist() for x in encoder.documents(whole)] == wanted
    for few in ([], [None], ["", None], ["a\xa0b"], [" "]):
        got = list(encoder.documents(pa.array(few, pa.string())))
        assert [x.tolist() for x in got] == [encoder.document(t).tolist() for t in few]
        assert all(x.dtype == ti.ID_TYPE for x in got)


class _Counted(dict):
    lookups = 0

    def __getitem__(self, piece):
        self.lookups += 1
        return np.array([len(piece)], ti.ID_TYPE).tobytes()


def test_a_piece_is_looked_up_once_a_batch():
    encoder = ti.WordEncoder(public_tokenizers.path(ti.VOCABULARY))
    encoder.pieces = _Counted()
    assert [x.tolist() for x in encoder.documents(pa.array(["a bb a"] * 500))] == [[1, 2, 1, ti.END]] * 500
    assert encoder.pieces.lookups == 2


def test_new_pieces_are_encoded_together(monkeypatch):
    path = public_tokenizers.path(ti.VOCABULARY)
    plain, encoder = Tokenizer.from_file(path), ti.WordEncoder(path)
    texts = _texts() + ["<|endoftext|>x 'sa It's a<|startoftext|> 'S <|END", "Ça ça ΑΣ İx é ½ a\x00b"] * 2
    wanted = [[*(plain.encode(t, add_special_tokens=False).ids if t else []), ti.END] for t in texts]
    whole = pa.array(texts, pa.string())
    for together, kept in ((ti.TOGETHER, ti.KEPT), (3, ti.KEPT), (7, 20)):
        monkeypatch.setattr(ti, "TOGETHER", together)
        monkeypatch.setattr(ti, "KEPT", kept)
        assert [x.tolist() for x in ti.WordEncoder(path).documents(whole)] == wanted
    single = []
    monkeypatch.setattr(encoder, "pieces", ti._Pieces(lambda piece: single.append(piece)))
    assert [x.tolist() for x in encoder.documents(pa.array(["one two", "deux été"]))] == [
        [*plain.encode(t, add_special_tokens=False).ids, ti.END] for t in ("one two", "deux été")
    ]
    assert single == []


def test_latin_letters_take_the_plain_path():
    path = public_tokenizers.path(ti.VOCABULARY)
    plain, encoder = Tokenizer.from_file(path), ti.WordEncoder(path)
    letters = [chr(c) for c in range(0x21, 0x180)] + ["e\u0301", "A\u030a", "\u0130", "\u1e9e"]
    rng = random.Random(11)
    texts = [f"x{c}y {c} {c}{c.upper()}'S 4{c}5" for c in letters]
    texts += [" ".join("".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(20)) for _ in range(300)]
    texts += ["été", "été,Straße", "Ñandú's", "a\xadb é", "é\u0301t"]
    wanted = [[*plain.encode(t, add_special_tokens=False).ids, ti.END] for t in texts]
    assert [x.tolist() for x in encoder.documents(pa.array(texts))] == wanted
    assert [encoder.document(t).tolist() for t in texts] == wanted
    whole = []
    fresh = ti.WordEncoder(path)
    fresh.tokenizer = type("Never", (), {"encode_batch_fast": lambda _, batch, **__: whole.extend(batch) or [plain.encode(x) for x in batch]})()
    some = ["Ça été", "GRÜẞE Größe ÀÉÎÕÜ ÿ", "naïve's 42ñ", "×2 漢"]
    assert [x.tolist() for x in fresh.documents(pa.array(some))] == [[*plain.encode(t, add_special_tokens=False).ids, ti.END] for t in some]
    assert sorted(whole) == ["GRÜẞE", "×2", "漢"]
