"""What the frames of a generation are made from."""

from catalog import source_queries
from tests.test_queries import SF


def test_frames_of_a_generation_read_stored_cards_and_parts(spark):
    """No text is cut again for a frame: cards and parts are stored once for all of them."""
    _, index = source_queries._built(spark, SF)
    for frame in (index.documents, index.card_parts, index.signatures):
        assert "EvalPython" not in frame._jdf.queryExecution().executedPlan().toString()
