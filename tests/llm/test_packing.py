import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import packing


@pytest.mark.parametrize("seed", range(8))
def test_patterns_hold_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(1, 50) for n in rng.sample(range(1, 101), 40)}
    patterns = packing.shortest_pack_first(counts, 100)
    held = Counter()
    for often, lengths in patterns:
        assert sum(lengths) <= 100 and lengths == sorted(lengths, reverse=True)
        for n in lengths:
            held[n] += often
    assert held == counts and len(patterns) <= 3 * len(counts)
    packs = []  # the same one piece at a time
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        room = max(packs, default=0)
        if room >= n:
            packs.remove(room)
            packs.append(room - n)
        else:
            packs.append(100 - n)
    assert len(packs) == sum(o for o, _ in patterns)


def test_pieces_give_the_ids_back(documents, prose):
    rows = [(k, prose(prose.rng.randint(1, 900))) for k in range(40)] + [(100, None), (101, ""), (102, "é" * 5000), (103, "a  b\n\n c <|endoftext|>"), (104, prose(9000)), (7, "again")]
    found = packing.pack_documents(documents(rows)).collect()
    own = Tokenizer.from_file(packing.default_vocabulary())
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for at in sequences.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    for k, text in rows:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        end = 0
        for start, length, crc in sorted(pieces[k, len(ids)]):
            assert start == end and crc == zlib.crc32(ids[start : start + length].tobytes())
            end += length
        assert end == len(ids)


def test_empty_table_repeated_rows_and_null_ids(documents):
    assert packing.pack_documents(documents([])).count() == 0
    found = packing.pack_documents(documents([(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert sorted((r.doc_id or -1, r.doc_tokens) for r in found) == [(-1, 2), (1, 3), (1, 3)] and len({(r.sequence_id, r.offset) for r in found}) == 3


def test_both_tokenizers_give_the_same_ids(spark):
    own = Tokenizer.from_file(packing.default_vocabulary())
    fast = packing.encoder(packing.default_vocabulary())
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|", " <|endoftext|><|endoftext|>\n"):
        assert fast(text) == own.encode(text, add_special_tokens=False).ids
    assert 50256 in fast("a <|endoftext|> b")
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert fast(r.text) == own.encode(r.text, add_special_tokens=False).ids
