"""Schemas, enumerations and priorities of the graph model. Tables are plain DataFrames with these columns."""

from __future__ import annotations

NODES = "name string, file string, type string, recommendation string"
EDGES = "src string, dst string"
FILE_EDGES = "file string, src string, dst string"
LINES = "file string, line_no int, text string"
LABELS = "label string, name string"

#: Names, in the order in which labels win.
LABEL_PRIORITY = ("INIT", "INIT_REACH", "SYSCALL", "TRACE", "EXPORT", "MODULAR", "VIRTUAL_STRUCTS", "USE_TRACE_SYSCALL", "VIRTUAL_STRUCTS_REACH_TOP")
DEFAULT_TYPE, EXTERNAL, VIRTUAL = "PLAIN", "EXTERNAL", "VIRTUAL"
#: Types whose nodes are contracted away before advice is given.
NON_MODULAR = ("INIT", "EXPORT", "INIT_REACH", "TRACE", "VIRTUAL_STRUCTS", "SYSCALL", "MODULAR", "USE_TRACE_SYSCALL")
RECOMMENDATIONS = ("INTERFACE", "NORMAL", "DELETE")
#: Fill colours of types and recommendations.
TYPE_COLOURS = {
    "INIT": "red",
    "INIT_REACH": "yellow",
    "EXPORT": "blue",
    "PLAIN": "white",
    "EXTERNAL": "green",
    "VIRTUAL": "gray",
    "VIRTUAL_STRUCTS": "brown",
    "VIRTUAL_STRUCTS_REACH_TOP": "goldenrod",
    "USE_TRACE_SYSCALL": "cyan",
    "TRACE": "darkgreen",
    "SYSCALL": "purple",
    "MODULAR": "orange",
}
RECOMMENDATION_COLOURS = {"INTERFACE": "blue", "NORMAL": "white", "DELETE": "red"}
#: Names that contraction and the points-to stage make.
SOURCE, DESTINATION = "virtual_source", "virtual_destination"
GLOBAL_PREFIX, INIT_SUFFIX = "__virtual__global__", "__virtual_init"
