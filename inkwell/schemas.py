"""Schemas of the engine's tables, as DDL."""

IMAGE = "page long, w int, h int, bits binary"
PAGE_INDEX = (
    "page long, w int, h int, row_start array<int>, runs array<struct<x0:int,len:int>>, comps array<struct<x0:int,y0:int,x1:int,y1:int,ink:int>>, "
    "clusters array<struct<x0:int,y0:int,x1:int,y1:int,ink:int,members:int>>, by_x0 array<int>, bytes long"
)
STORED_PAGE = (
    "page long, w int, h int, runs binary, comps array<struct<x0:int,y0:int,x1:int,y1:int,ink:int>>, clusters array<struct<x0:int,y0:int,x1:int,y1:int,ink:int,members:int>>, error string"
)
MATCH_PX = "page long, ord int, x int, y int, w int, h int, score double, forward double, reverse double, scale double"
MATCH = "page long, reading_ord int, x_norm double, y_norm double, w_norm double, h_norm double, score double"
