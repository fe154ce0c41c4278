import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs
import pytest

from pointloom.llm import idfile, pieces
from pointloom.scratch import new_path

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def test_pieces(messy, documents, nothing):
    sp = pieces.processor(PIECES)
    for docs in (messy, documents, nothing):
        want = []
        for r in docs.collect():
            ids = sp.encode(r.text or "")
            want.append(str((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((sp.decode(ids) if ids else "").encode()).hexdigest())))
        assert sorted(want) == sorted(str(tuple(r)) for r in pieces.digests(docs, PIECES).collect())


def test_model_is_checked():
    assert pieces.words_stand_alone(PIECES)


def test_id_files(spark, messy, documents, nothing):
    t = idfile.tokenizer(WORDS)
    for docs in (messy, documents, nothing):
        rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        want, start = [], 0
        for r in rows:
            ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, idfile.END_ID], "<u4")
            want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        got = [tuple(r) for r in idfile.round_trip(docs, WORDS).collect()]
        assert sorted(got, key=lambda r: r[1]) == want


def test_chunks_are_encoded_together():
    """Many chunks in one string, a mark between them; chunks that hold the mark, or nothing to encode, keep their ids."""
    t = idfile.tokenizer(WORDS)
    words = [f"w{k}'s" for k in range(2 * idfile.JOINED + 7)] + ["<|endoftext|>", "\u0301", "\u00a0", "e\u0301", "\ud7ff", "a\u2003b"]
    for chunks in (words, [*words, idfile.MARK, f"a{idfile.MARK}b"], [idfile.MARK], ["\u00a0"], []):
        ids, lengths = idfile.encode_chunks(chunks, WORDS)
        want = [t.encode(x, add_special_tokens=False).ids for x in chunks]
        assert lengths.tolist() == list(map(len, want)) and ids.tolist() == [x for y in want for x in y]


def test_random_access(spark, documents):
    path = new_path(spark, "ids")
    idfile.write(documents, path, WORDS)
    rows = {r.doc_id: r for r in idfile.read(spark, path).collect()}
    fs, root = pyarrow.fs.LocalFileSystem(), path
    names = [x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(root)) if x.path.endswith(".ids")]
    assert not [x for x in fs.get_file_info(pyarrow.fs.FileSelector(root)) if "attempt" in x.path]
    for name in names:
        with fs.open_input_file(name) as source:
            file = idfile.IdFile(source)
            for k, doc in enumerate(file.doc_ids().to_pylist()):
                assert file.ids(*file.span(k)).astype("<u4").tobytes() == rows[doc].ids_le32


@pytest.mark.parametrize(("n", "top"), [(0, 0), (1, 0), (1, 9), (1000, 10**6), (5000, 20), (777, 2**40)])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    code = idfile.EliasFano.from_bytes(idfile.EliasFano.of(values).to_bytes())
    assert (code.all() == values).all() and [code[i] for i in range(n)] == values.tolist()
    if n >= 1000:
        assert len(code.to_bytes()) * 8 < n * (2.3 + max(0.0, np.log2(max(top, 1) / n)) + 1) + 400
