"""Words remembered by both tokenizers against texts encoded whole."""

import numpy as np

from nucleoflow.llm import alignment
from nucleoflow.llm.queries import BYTES, PIECES, vocabulary

TEXTS = [
    "the cat sat on the mat, the cat sat on the mat " * 20,
    " leads  with two spaces and ends with one ",
    "tab\tand\nbreak 12 345 6,7  x",
    "naïve été 中文 　wide　 space  hard  ▁mark ▁ a▁ b",
    "<s> </s> <unk> <0x41> <|endoftext|> a",
    "\U0001f600 \U0001f600 ä ̈b 힣 e",
    "x",
    " ",
    "\n",
]


def _arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))


def _tokenizers():
    return alignment.ByteTokenizer(vocabulary(BYTES)), alignment.PieceTokenizer(vocabulary(PIECES))


def test_words_give_the_ids_of_whole_texts():
    both = _tokenizers()
    words = alignment.Words(*both)
    for texts in (TEXTS, TEXTS[::-1], TEXTS[3:5]):
        for tokenizer, (ids, n) in zip(both, words.ids(*_arrays(texts)), strict=True):
            want = tokenizer.encode([t.encode() for t in texts])
            assert n.tolist() == [len(x) for x in want]
            assert ids.tolist() == [i for x in want for i in x]


def test_each_word_is_encoded_once():
    """Neither tokenizer sees a repeated word again; whole texts went through the pieces before."""
    both = _tokenizers()
    seen = [0, 0]
    for k, tokenizer in enumerate(both):
        assert tokenizer.parts

        def counted(texts, k=k, encode=tokenizer.encode):
            seen[k] += sum(map(len, texts))
            return encode(texts)

        tokenizer.encode = counted
    words = alignment.Words(*both)
    data, offsets = _arrays(TEXTS[:1] * 5)
    words.ids(data, offsets)
    words.ids(data, offsets)
    assert max(seen) < 100
