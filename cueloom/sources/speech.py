"""Speech for narrated slides: a generator that is passed in, retries, and the events that it reports."""

from __future__ import annotations

import ssl
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from cueloom.errors import SynthesisError
from cueloom.operators.merge import narratable
from cueloom.schemas import EVENTS
from cueloom.sources.audio import synthesize

#: Text and voice in; words with their offset and duration in milliseconds out.
Generator = Callable[[str, str], list[tuple[str, int, int]]]


def retryable(error: Exception) -> bool:
    """Trouble with a connection or the system may pass; a missing program, a bad certificate or a wrong argument stays."""
    lasting = (FileNotFoundError, ssl.SSLCertVerificationError, TypeError, ValueError)
    return isinstance(error, OSError) and not isinstance(error, lasting)


def spoken(text: str, voice: str, generator: Generator, retries: int, delay_s: float) -> list[tuple[str, int, int]]:
    left = max(0, retries)
    while True:
        try:
            return generator(text, voice)
        except Exception as e:
            if not left or not retryable(e):
                raise SynthesisError(f"no speech after {max(0, retries) - left + 1} tries: {e}") from e
        left -= 1
        time.sleep(delay_s)


def generate(slides: DataFrame, voice: str = "neutral", generator: Generator = synthesize, retries: int = 2, delay_s: float = 1.0) -> DataFrame:
    """The timed words of every narratable slide. A slide that can't be spoken ends the job, as later steps need all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for deck, slide, notes in batch.itertuples(index=False, name=None):
                events = spoken(notes, voice, generator, retries, delay_s)
                yield pd.DataFrame([(deck, slide, i, *e) for i, e in enumerate(events)], columns=["deck_id", "slide_num", "ev_idx", "text", "offset_ms", "duration_ms"])

    return slides.where(narratable()).select("deck_id", "slide_num", "notes").mapInPandas(run, EVENTS)
