"""Stateful decoding and encoding of frame streams: the state of a movie is its framebuffer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..sources import codec

_STATE = "frame long, data binary"


def _in_order(batches, state):
    """Rows by frame; going back is an error."""
    rows = pd.concat(list(batches)).sort_values("frame")
    at = state.get[0] if state.exists else -1
    for r in rows.itertuples():
        if r.frame <= at:
            raise ValueError(f"frame {r.frame} of {r.movie} after frame {at}")
        at = r.frame
        yield r


def decode_stream(frame_data: DataFrame) -> DataFrame:
    """movie, frame, is_duplicate, data (whole frames) from a stream of container frames, in frame order across batches."""

    def step(key, batches, state):
        frame, out, at = None, [], -1
        for r in _in_order(batches, state):
            if frame is None:
                frame = np.frombuffer(state.get[1], codec.pixel_type(r.bpp)).copy() if state.exists else np.zeros(r.width * r.height, codec.pixel_type(r.bpp))
            if not r.is_nop:
                codec.apply_frame(frame, r.data, r.bpp, r.is_key)
            out.append((key[0], r.frame, bool(r.is_nop), frame.tobytes()))
            at = r.frame
        if out:
            state.update((at, frame.tobytes()))
        yield pd.DataFrame(out, columns=["movie", "frame", "is_duplicate", "data"])

    return frame_data.groupBy("movie").applyInPandasWithState(step, "movie string, frame long, is_duplicate boolean, data binary", _STATE, "append", "NoTimeout")


def encode_stream(frames: DataFrame, bpp: int, keyframe_every: int = 10000) -> DataFrame:
    """movie, frame, frame_class, adler, data (payload) from a stream of whole frames (movie, frame, data)."""

    def step(key, batches, state):
        out, at = [], -1
        old = np.frombuffer(state.get[1], codec.pixel_type(bpp)) if state.exists else None
        for r in _in_order(batches, state):
            new = np.frombuffer(r.data, codec.pixel_type(bpp))
            is_key = keyframe_every <= 1 or r.frame % keyframe_every == 0
            kind, data = codec.encode_frame(old, new, bpp, is_key)
            out.append((key[0], r.frame, kind, 0 if kind == "nop" else codec.adler(new, bpp), data))
            old, at = new, r.frame
        if out:
            state.update((at, old.tobytes()))
        yield pd.DataFrame(out, columns=["movie", "frame", "frame_class", "adler", "data"])

    return frames.groupBy("movie").applyInPandasWithState(step, "movie string, frame long, frame_class string, adler long, data binary", _STATE, "append", "NoTimeout")
