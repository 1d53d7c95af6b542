"""Pieces of a public SentencePiece model; the model file stays where it is and is read on the driver."""

from __future__ import annotations

from functools import lru_cache

#: Default place of the model file.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@lru_cache(maxsize=4)
def pieces(path: str = MODEL) -> tuple[tuple[str, float, str], ...]:
    """(piece, score, kind) by id; kind: normal, byte, control or unknown."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if model.is_byte(i) else "control" if model.is_control(i) else "unknown" if model.is_unknown(i) else "normal"
    return tuple((model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size()))
