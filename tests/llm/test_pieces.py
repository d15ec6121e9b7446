"""How much text the encoder hands to the library."""

import pytest

from veriloom.llm import tokens


class Counting:
    """A tokenizer that counts the characters it is given, and the calls that ask for offsets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.chars, self.full = tokenizer, 0, 0

    def encode(self, text, **options):
        self.chars, self.full = self.chars + len(text), self.full + 1
        return self.tokenizer.encode(text, **options)

    def encode_batch(self, texts, **options):
        self.chars, self.full = self.chars + sum(map(len, texts)), self.full + 1
        return self.tokenizer.encode_batch(texts, **options)

    def encode_batch_fast(self, texts, **options):
        self.chars += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_word_with_signs_is_encoded_once(name):
    """Signs behind a word make no new piece of it, and "..." leaves the text cut."""
    own = tokens.Encoder(tokens.vocabulary(name))
    words = [f"éw{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    texts = [" " + " ".join(f"{x}{sign}" for x in words) for sign in ("", "...", "!!!", "$$$", "%%%", "&&&", "***", "???")]
    want = own.library(texts)
    own.tokenizer = own.known.tokenizer = counted = Counting(own.tokenizer)
    assert own.encode(texts) == want
    assert counted.chars <= len(texts[0]) + 100 and counted.full <= 10


def test_ids_tell_where_pieces_begin():
    """Pieces of one word each are cut by their ids; where these don't tell, by offsets."""
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = tokens.Encoder(tokens.vocabulary(name)).known
        pieces = [" house", "\nÉtude", " x", " antidisestablishmentarianism", " İstanbul"]
        assert own.joined(pieces) == own.together(pieces)
        assert own.joined(pieces[:4]) == own.together(pieces[:4])
    own = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json")).known
    assert own.joined([" don't", " a-b"]) == own.together([" don't", " a-b"])
