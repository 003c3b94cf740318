"""Sound as samples: WAV files with the standard library; other formats need an outside decoder."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from cueloom.errors import Unsupported

RATE = 8000


def decode_wav(content: bytes, rate: int = RATE) -> np.ndarray | None:
    """Mono float samples at rate, nearest sample by time; None if it isn't a WAV file of 8, 16 or 32 bits."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            raw, channels, width, own = w.readframes(w.getnframes()), w.getnchannels(), w.getsampwidth(), w.getframerate()
        x = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float32)
    except (wave.Error, EOFError, KeyError, ValueError):
        return None
    x = (x - 128 if width == 1 else x).reshape(-1, channels).mean(axis=1) / float(1 << (8 * width - 1))
    at = np.arange(int(len(x) * rate / own)) * own / rate
    return x[np.minimum(at.astype(int), len(x) - 1)].astype(np.float32) if len(x) else x


def read_wav(spark: SparkSession, path: str, rate: int = RATE) -> DataFrame:
    """path, audio_ms (null if it can't be decoded) and samples of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            decoded = [decode_wav(bytes(c), rate) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "audio_ms": pd.array([None if x is None else len(x) * 1000 // rate for x in decoded], "Int64"), "samples": decoded})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, audio_ms bigint, samples array<float>")


def extract_track(video: str, wav: str) -> None:
    raise Unsupported("taking the sound from a video needs an outside media tool")


def synthesize(text: str, voice: str) -> list[tuple[str, int, int]]:
    """A steady voice for tests: each voiced character with its offset and duration in milliseconds."""
    return [(c, 200 * i, 160) for i, c in enumerate(text) if c not in " \n.,!?"]
