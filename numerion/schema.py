"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
DIGIT = "struct<x:int,y:int,w:int,h:int,line:int,label:int,confidence:double,accepted:boolean,quad:array<array<int>>>"
REJECTED = "struct<x:int,y:int,w:int,h:int,reason:string,quad:array<array<int>>>"
PAPER = "struct<found:boolean,quad:array<array<int>>,area_fraction:double,fills_frame:boolean>"

#: One row per image of a full detection run.
DETECTION = f"image string, status string, height int, width int, ref_height double, text string, digit_count int, digits array<{DIGIT}>, rejected array<{REJECTED}>, paper {PAPER}"
TRUTH = "image string, lines array<string>, category string"
DATASET = "idx long, split string, pixels binary, label int"
