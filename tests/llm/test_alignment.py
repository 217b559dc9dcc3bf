"""Token alignment against a plain version over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from starloom.llm import alignment
from starloom.llm.bpe import byte_letters
from starloom.llm.store import reach_workers

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    "The quick brown fox.\nIt's here, 'LL see 12 of them!", None, "", " \t\n ", " ", "  two  blanks  ", "tail ",
    "a  b\n\nc 　d\x1ce <|endoftext|> <s> <0x41> tail ", "with ▁ a mark", "x" * 3000, "İstanbul, Σίσυφος. été 😀 中文",
    " ".join(f"word{i % 701} und" for i in range(4000)), "copy me", "copy me", "copy me", "nul \x00 here", "  \u0085 x\ty z",
]


def brute(texts):
    """A row of measures for each text."""
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = byte_letters()
    aligned = []
    for text in texts:
        raw = f" {text}".encode()
        a = library.encode(f" {text}", add_special_tokens=False)
        b = pieces.encode(text or "")
        spell = [
            bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ]
        a_spell = [bytes(letters[c] for c in t) for t in a.tokens]
        if not text or b"".join(spell) != raw or b"".join(a_spell) != raw:
            aligned.append(None)
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in s]).tolist() for s in (a_spell, spell))
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a.ids[i:x], b[j:y]))
            i, j = x, y
        aligned.append((len(a.ids), len(b), groups))
    count = Counter()
    for row in aligned:
        if row:
            count.update({(p, q) for x, y in row[2] for p in x for q in y})
    best = {}
    for (p, _), n in count.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for row in aligned:
        if not row:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(p, q) for x, y in row[2] for p in x for q in y]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in row[2])
        digest = hashlib.sha256(shown.encode()).hexdigest()
        out.append((row[0], row[1], len(row[2]), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), digest))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_documents_match_the_plain_version(spark):
    reach_workers(spark)
    ids = [None if i == 4 else min(i, 9) for i in range(len(TEXTS))]
    rows = [(i, t, "clash", b"k") for i, t in zip(ids, TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, key binary").repartition(3)
    want = Counter((i, *m) for i, m in zip(ids, brute(TEXTS)))
    for limit in (1_000_000, 0):  # broadcast joins and shuffled ones
        got = alignment.align_documents(docs, A, B, broadcast_rows=limit)
        assert got.columns == COLUMNS
        assert Counter(map(tuple, got.collect())) == want
    assert alignment.align_documents(docs.where("false"), A, B).count() == 0


def test_hot_text_and_frequent_pairs(spark):
    """Copies and pairs beyond the heavy mark take the broadcast side."""
    reach_workers(spark)
    texts = ["the same text"] * 700 + [f"the text {i}" for i in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = alignment.align_documents(docs, A, B, broadcast_rows=0).collect()
    want = Counter((i, *m) for i, m in zip(range(len(texts)), brute(texts)))
    assert Counter(map(tuple, got)) == want


def test_chunks_equal_whole_texts(monkeypatch):
    """Chunks of odd texts give what the whole text gives, also when the
    worker's table starts anew all the time."""
    monkeypatch.setattr(alignment, "MAX_CHUNKS", 50)
    monkeypatch.setattr(alignment, "GROUP_CHARS", 200)
    rng = random.Random(4)
    parts = ["a", "the", " ", "  ", "\n", "\t", " ", "　", "'s", "'ll", "12", "3.", ",", "...", "é", "😀", "中", "\x1c", "\x00", "ﬁ", "▁",
             "<0x0A>", "</s>", "<|endoftext|>", "Word", "x" * 20, "́", "-", "http://a.b/c?d=e"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(2500)]
    aligner = alignment.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    got = [(*n, d) for numbers, digests, *_ in aligner.align(texts) for n, d in zip(numbers.tolist(), digests)]
    assert got == [(*m[:4], m[6]) for m in brute(texts)]


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    """Pairs of a group, listed one by one or by its distinct ids."""
    a, b = open(A, encoding="utf-8").read(), open(B, "rb").read()
    texts = ["\u3042\u3044\u3046" * 9 + " word", "\u3042" * 30, "plain text"]
    listed = list(alignment.Aligner(a, b).align(texts))
    monkeypatch.setattr(alignment, "LISTED", 1)
    for one, other in zip(listed, alignment.Aligner(a, b).align(texts)):
        for x, y in zip(one, other):
            assert np.array_equal(x, y)
    counted = {}
    for numbers, _, sizes, _, times in listed:
        assert times.sum() == numbers[:, 3].sum() and sizes.sum() == len(times)
        counted["links"] = numbers[:, 3].tolist()
    assert counted["links"] == [m[3] for m in brute(texts)]
