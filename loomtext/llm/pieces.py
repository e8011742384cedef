"""A SentencePiece vocabulary as plain lists, read once on the driver and broadcast.

Its size is fixed by the tokenizer, so broadcasting it is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

SPACE = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Ordinary pieces with their scores and ids, and the ids of the 256 byte pieces."""

    pieces: list[str]
    scores: list[float]
    ids: list[int]
    bytes_: list[int]
    unknown: int

    @property
    def cuts_at_newline(self) -> bool:
        """Whether no piece holds a line feed, so that texts may be taken line by line."""
        return not any("\n" in p for p in self.pieces)


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file with byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary, byte_ids = [], {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ordinary.append(i)
    if len(byte_ids) != 256:
        raise ValueError(f"{path} has no complete set of byte pieces")
    return Vocabulary(
        [model.id_to_piece(i) for i in ordinary],
        [model.get_score(i) for i in ordinary],
        ordinary,
        [byte_ids[b] for b in range(256)],
        model.unk_id(),
    )
