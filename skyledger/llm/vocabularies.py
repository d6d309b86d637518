"""Where the public tokenizers' vocabulary files lie."""

from __future__ import annotations

import os


def vocabulary(name: str) -> str:
    """The path of a vocabulary file; the folder can be named in SKYLEDGER_VOCABULARIES."""
    folder = os.environ.get("SKYLEDGER_VOCABULARIES")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
