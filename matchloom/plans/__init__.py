from matchloom.plans import ball_queries, match_run, play_queries, tracking_queries, vision_queries  # noqa: F401
from matchloom.plans.registry import ORACLE, QUERIES  # noqa: F401
