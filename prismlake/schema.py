"""The canonical table of assets that every source is projected into."""

from __future__ import annotations

MEDIA = (
    "ord bigint, photo_id string, source string, media_type string, filename string, filepath string, filesize bigint, width int, height int, "
    "taken_at timestamp, is_favorite boolean, is_archived boolean, persons array<string>, albums array<string>, keywords array<string>, "
    "duplicate_group string, exif map<string,string>, hash_hi bigint, hash_lo bigint, "
    "video struct<frames:array<bigint>,thumb:bigint,duration:double,frame_count:int>, "
    "faces array<struct<top:int,right:int,bottom:int,left:int>>, updated_at timestamp"
)
