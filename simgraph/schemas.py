"""Declared schemas of the engine's tables, as DDL; an empty result never changes them."""

from __future__ import annotations

FILE_INDEX = "asset_id string, path string, type string, mtime bigint, size bigint, sha256 string, width int, height int, fps double, duration double, codec string, num_frames int"
EXACT_GROUPS = "asset_id string, group_id bigint, sha256 string"
HASHES = "asset_id string, frame_index int, ahash string, dhash string, phash string"
GROUPS = "asset_id string, group_id bigint"
PAIRS = "asset_id_a string, asset_id_b string, coarse_similarity double"
SCORED_PAIRS = "asset_id_a string, asset_id_b string, type_a string, type_b string, similarity double, status string"
VIDEO_ALIGNMENT = "asset_id_a string, asset_id_b string, offset int, match_count int, overlap_ratio double, is_duplicate boolean"
RANKED = "asset_id string, group_id bigint, path string, rank int, is_keeper boolean, duration_bucket double, resolution bigint, quality_key double, mtime bigint"
EMBEDDINGS = "id string, modality string, embedding array<float>"
FRAME_EMBEDDINGS = "asset_id string, frame_index int, embedding array<float>"
PERSONS = "asset_id string, type string, detections array<struct<source:string,bbox:array<double>,confidence:double>>"
FACES = "asset_id string, faces array<struct<source:string,person_det_index:int,bbox:array<double>,confidence:double,embedding:array<float>>>"
ENTITIES = "entity_id string, asset_id string, type string, frames array<struct<source:string,person_bbox:array<double>,faces:array<struct<bbox:array<double>,confidence:double>>>>, has_face boolean"
ASSIGNMENTS = "entity_id string, cluster_id int"
CENTROIDS = "cluster_id int, centroid array<double>"
OVERRIDES = "version bigint, seq bigint, id bigint, group_id bigint"
RASTERS = "asset_id string, frame_index int, height int, width int, pixels binary"
