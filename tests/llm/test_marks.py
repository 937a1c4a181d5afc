"""op5 cuts marks off the words they end, where the tokenizer does so itself, and gets the tokenizer's ids."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from caregrid.llm import words

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_a_word_is_encoded_once_for_all_marks(monkeypatch):
    kept, encoded = words.TokenizerIds(BYTE), []
    encode = kept.encode
    monkeypatch.setattr(kept, "encode", lambda chunks: encoded.extend(chunks) or encode(chunks))
    kept.ids(["Ein Baum, ein Baum. Ein Baum! Ein Baum?! ein Baum"])
    assert sorted(encoded) == sorted(["Ein", " Ein", " ein", " Baum", ",", ".", "!", "?!"])


def test_ids_are_the_librarys():
    kept, tok = words.TokenizerIds(BYTE), Tokenizer.from_file(BYTE)
    rng = random.Random(3)
    parts = ["don't", "it's", "'s", "we'LL", "a", "Été", "ÿ", "ɏ", "×", "÷", "中", "é", "12", "x2", "(", ")", "-", "'", "|", "<|endoftext|>", "<", "_", "...", ".", ",", "!?", "%", "$$", "#", "&", "*", ";:", " ", "  ", "\n", "\t", "\xa0", " ", "\r\n", "​", "\U0001f600"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(20000)] + ["." * 5000 + "a", "a" * 5000 + ".", "a" + "." * 5000 + "b c."]
    for text, ids in zip(texts, kept.ids(texts)):
        assert "".join(kept.cut(text)) == text
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)
