"""Recordings as WAV files: what they are like, and where long ones can be cut.

Other containers need a reader of their own; their recordings come in as segments.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Seconds of the longest piece that goes to a transcriber, and of its end in which the quietest place is looked for.
LONGEST, SEARCHED = 600.0, 60.0
#: Seconds over which loudness is measured.
FRAME = 0.1


def _samples(raw: bytes, width: int) -> np.ndarray:
    """Samples between -1 and 1; of 8 bits without a sign, as WAV has them, and of 24 bits by their upper 16."""
    if width == 1:
        return (np.frombuffer(raw, dtype=np.uint8).astype(np.float32) - 128) / 128
    if width == 3:
        raw, width = np.frombuffer(raw[: len(raw) // 3 * 3], dtype=np.uint8).reshape(-1, 3)[:, 1:].tobytes(), 2
    return np.frombuffer(raw[: len(raw) // width * width], dtype=f"<i{width}").astype(np.float32) / (1 << (8 * width - 1))


def probe(content: bytes) -> dict:
    """Seconds, samples a second, channels and thousand bits a second."""
    with wave.open(io.BytesIO(content)) as w:
        seconds = w.getnframes() / w.getframerate()
        return {"seconds": seconds, "hertz": w.getframerate(), "channels": w.getnchannels(), "kbps": w.getframerate() * w.getnchannels() * w.getsampwidth() * 8 / 1000}


def quiet_cuts(loudness: np.ndarray, frame: float = FRAME, longest: float = LONGEST, searched: float = SEARCHED) -> list[int]:
    """Frames at which pieces begin: a piece ends at the quietest frame of its last ``searched`` seconds (of its second
    half, if that is shorter), the latest of those equally quiet."""
    most = max(2, int(longest / frame))
    tail = max(1, min(int(searched / frame), most // 2))
    starts = [0]
    while len(loudness) - starts[-1] > most:
        end = starts[-1] + most
        starts.append(end - 1 - int(np.argmin(loudness[end - tail : end][::-1])))
    return starts


def pieces(content: bytes, longest: float = LONGEST, searched: float = SEARCHED) -> list[tuple[float, bytes]]:
    """(offset in seconds, WAV bytes) of a recording, cut where it is quiet; a short one is whole."""
    with wave.open(io.BytesIO(content)) as w:
        params = w.getparams()
        size = max(1, int(FRAME * params.framerate))
        loud = []
        while raw := w.readframes(size):
            x = _samples(raw, params.sampwidth)
            loud.append(float(np.sqrt(np.mean(x * x))) if len(x) else 0.0)
        starts = quiet_cuts(np.array(loud), size / params.framerate, longest, searched)
        if len(starts) == 1:
            return [(0.0, content)]
        out = []
        for a, b in zip(starts, [*starts[1:], len(loud)], strict=True):
            w.setpos(a * size)
            held = io.BytesIO()
            with wave.open(held, "wb") as piece:
                piece.setnchannels(params.nchannels)
                piece.setsampwidth(params.sampwidth)
                piece.setframerate(params.framerate)
                piece.writeframes(w.readframes((b - a) * size))
            out.append((a * size / params.framerate, held.getvalue()))
    return out


def probed(recordings: DataFrame) -> DataFrame:
    """(doc_id, seconds, hertz, channels, kbps, error) of recordings (doc_id, content)."""

    def run(parts):
        for part in parts:
            rows = []
            for doc, content in zip(part["doc_id"], part["content"], strict=True):
                try:
                    rows.append({"doc_id": doc, "error": None} | probe(bytes(content)))
                except Exception as e:  # noqa: BLE001
                    rows.append({"doc_id": doc, "seconds": None, "hertz": None, "channels": None, "kbps": None, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["doc_id", "seconds", "hertz", "channels", "kbps", "error"]).astype({"hertz": "Int64", "channels": "Int64"})

    return recordings.select("doc_id", "content").mapInPandas(run, "doc_id string, seconds double, hertz long, channels long, kbps double, error string")


def in_pieces(call: Callable[[bytes], list[tuple]], longest: float = LONGEST) -> Callable[[bytes], list[tuple]]:
    """A transcriber of whole recordings from one of short ones: (text, start, end), times counted from the recording's start."""

    def run(content: bytes) -> list[tuple]:
        return [(text, offset + start, offset + end) for offset, piece in pieces(content, longest) for text, start, end in call(piece)]

    return run
