"""Nothing outside the text subpackage imports it."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_only_the_entry_names_the_text_subpackage():
    for f in [*(ROOT / "lodestrata").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        if "llm" not in f.relative_to(ROOT).parts and f.name != "test_imports.py":
            assert not re.search(r"(?:from|import)\s+lodestrata\.llm", f.read_text()), f
