"""Default parameters. Every one can be given to the functions that use it."""

# The semantics' constants.
MAP_WIDTH = 3629.0
MAP_HEIGHT = 4161.0
MAX_SNAP_CELLS = 24
MAX_GAP_CELLS = 0
ROAD_BIAS = 1.35
GAP_PENALTY = 8.0
MAIN_MIN_CLEARANCE = 2
MAIN_COMPONENT_REFERENCE = 420
PIVOT_LIMIT = 1e-12
MIN_CONTROL_POINTS = 3
NO_BLOCK = 32767
MAX_STOPS = 32
SEARCH_LIMIT = 40
AMBIGUOUS_LIMIT = 8
NAME_LIMIT = 12
MIN_SEGMENT_PX = 96.0
ZONES = 4
TOUR_FLOOR, TOUR_SCALE, TOUR_POWER = 80.0, 700.0, 0.85
ZONE_BOOST, TYPE_BOOST = 1.45, 1.2
KEY_BONUS, DORM_BONUS = 4, 1
POLL = "5 seconds"

# What summaries say.
ROUTE_TEXT = "%d 个网格点，约 %.0fpx，跨 %d 个假断点"
TOUR_TEXT = "智能观光路线：从%s出发，途经 %d 处，约 %.0fpx"
TOUR_SKIPPED_TEXT = "，跳过 %d 处不可达点"
EXIT_TEXT = "最近离开路线：%s，约 %.0fpx"

# Tour weight of each place type, in its usual order.
TYPE_WEIGHTS = {
    "landscape": 10,
    "square": 8,
    "bridge": 8,
    "sports": 6,
    "dining": 6,
    "service": 5,
    "building": 4,
    "gate": 3,
    "dormitory": 2,
}
BOOSTED_TYPES = ("landscape", "square")
