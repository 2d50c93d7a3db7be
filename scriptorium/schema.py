"""Declared schemas of the bibliographic tables.

A field that may be one integer or a list is an array with a flag beside it: a
list of one is not the same as one integer, in keys and in scores.
"""

from __future__ import annotations

RECORDS = """pos int, kind string, input string, raw string, title string, subtitle string, journaltitle string,
author string, editor string, publisher string, location string, page_count int, ark string,
publicationdate array<int>, publicationdate_is_list boolean, number array<int>, number_is_list boolean,
volume array<int>, volume_is_list boolean, pages array<string>, physical_pages array<int>, error string"""
CATALOGUE = "pos int, identifier array<string>, title array<string>, publisher array<string>, date string, language array<string>, type array<struct<lang:string,text:string>>"
ISSUES = "series_ark string, year int, pos int, ark string, label string"
ISSUE_META = "ark string, title string, publisher string, identifier string, description array<string>"
PAGE_MAP = "ark string, pos int, numero string, ordre int, pagination_type string"
TOC_XML = "ark string, xml string"
TOC_ENTRIES = "ark string, pos int, pno string, title string"
PAGE_TEXT = "ark string, ordre int, text string"
OCR_BOXES = "ark string, ordre int, upper struct<x:int,y:int>, lower struct<x:int,y:int>, total_width int, total_height int"
PAGE_PIXELS = "doc string, page int, y int, x int, v int"
CACHE = "name string, key string, value string, version bigint"
