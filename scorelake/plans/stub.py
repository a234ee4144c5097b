"""A deterministic stand-in transcriber for checking the inference path.

It "hears" audio whose bytes are UTF-8 text: the transcript is that text
with every fourth space-separated word missing, stripped. Audio whose text
contains a question mark fails with ``RuntimeError: decode failed``.
"""

from __future__ import annotations

from typing import Any

import numpy as np

from scorelake.operators.inference import ENGINES, Registry, Transcriber, register_transcriber

STUB_ENGINE = "echo"


class EchoTranscriber(Transcriber):
    def load(self) -> None:
        self.loaded = True

    def transcribe(self, audio: Any) -> str:
        text = bytes(audio).decode("utf-8") if isinstance(audio, (bytes, bytearray)) else str(audio)
        if "?" in text:
            raise RuntimeError("decode failed")
        kept = [w for i, w in enumerate(text.split(" "), start=1) if i % 4 != 0]
        return " ".join(kept).strip()


class ProbeTranscriber(Transcriber):
    """Answers with the number of samples and a checksum of the audio it was given."""

    def load(self) -> None:
        self.loaded = True

    def transcribe(self, audio: Any) -> str:
        samples = np.asarray(audio["array"], dtype=np.float32)
        return f"{samples.shape[0]}:{int(np.floor(samples.astype(np.float64) * 1024).sum())}"


class OptionsTranscriber(Transcriber):
    """Answers with its model and options."""

    def load(self) -> None:
        self.loaded = True

    def transcribe(self, audio: Any) -> str:
        return ",".join([self.model, *(f"{k}={v}" for k, v in sorted(self.options.items()))])


class DescribingTranscriber(Transcriber):
    """Answers with the kind of value it was given and what is in it."""

    def load(self) -> None:
        self.loaded = True

    def transcribe(self, audio: Any) -> str:
        if audio is None:
            return "none"
        if isinstance(audio, str):
            return f"path:{audio}"
        if isinstance(audio, (bytes, bytearray)):
            return f"bytes:{bytes(audio).decode('utf-8')}"
        if isinstance(audio, dict) and audio["array"] is None:
            return "value:" + ",".join(k for k in ("sampling_rate", "bytes", "path") if audio[k] is not None)
        rate = int(audio["sampling_rate"]) if isinstance(audio, dict) and audio["sampling_rate"] is not None else 0
        samples = audio["array"] if isinstance(audio, dict) else audio
        frames = np.asarray([np.asarray(f, dtype=np.float64) for f in samples]) if len(samples) else np.zeros(0)
        shape = "x".join(map(str, frames.shape))
        return f"array:{shape}:{rate}:{int(np.floor(frames * 1024).sum())}"


class BrokenTranscriber(EchoTranscriber):
    """Does not load models of which the name holds ``LLM``."""

    def load(self) -> None:
        if "LLM" in self.model:
            raise OSError(f"no weights for {self.model}")
        super().load()


def stub_registry(factory: str) -> Registry:
    """Every engine answered by one stand-in."""
    registry = Registry()
    for engine in ENGINES:
        registry.register(engine, factory)
    return registry


register_transcriber(STUB_ENGINE, "scorelake.plans.stub:EchoTranscriber")
