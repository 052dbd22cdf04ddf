import pytest

pytest.importorskip("factloom.llm")
