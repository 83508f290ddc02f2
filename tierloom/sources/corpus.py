"""Where the parts of a corpus are."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from tierloom.errors import IngestError
from tierloom.sources.lines import trace_files

_VECTORS = (".npy", ".parquet", ".jsonl")


@dataclass(frozen=True)
class Corpus:
    """Paths of the traces and of the vectors; None for what there isn't."""

    traces: str | None
    vectors: str | None


def locate(root: str) -> Corpus:
    """A folder with ``traces`` and ``embeddings`` below it; or a flat one of JSONL files and vector files; or a file of either kind."""
    at = Path(root)
    if at.is_file():
        return Corpus(None, str(at)) if at.suffix in (".npy", ".parquet") else Corpus(str(at), None)
    if not at.is_dir():
        raise IngestError(f"no corpus at {root}")
    own = {name: at / name for name in ("traces", "embeddings") if (at / name).is_dir()}
    if own:
        return Corpus(str(own["traces"]) if "traces" in own else None, str(own["embeddings"]) if "embeddings" in own else None)
    vectors = sorted(p for p in at.iterdir() if p.suffix in (".npy", ".parquet") and p.name != "ids.npy")
    lines = trace_files(str(at))
    if not vectors and not lines:
        raise IngestError(f"neither traces nor vectors in {root}")
    return Corpus(str(at) if lines else None, str(vectors[0]) if len(vectors) == 1 else str(at) if vectors else None)
