"""Column names and types of the part-hierarchy tables."""

from __future__ import annotations

NODES = "image_id long, z int, x int, y int, m int, r double, g double, rr double, node_id long"
EDGES = "src long, dst long, name string, idx int"
BOXES = "image_id long, box_id long, m int, val double, llx int, lly int, urx int, ury int"
GROUND_TRUTH = "image_id long, gt_id long, label string, llx int, lly int, urx int, ury int"
LIB_CENTER = "part int, center_m int, cmx int, cmy int, bp int"
LIB_SUB = "part int, idx int, sub_m int, dx int, dy int"
KERNEL = "i int, j int, w double"

#: A node's place; with its type it is a node's identity.
CELL = ("image_id", "z", "x", "y")
