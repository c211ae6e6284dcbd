import pytest

pytest.importorskip("tallyforge.llm")
