"""Readers for frames, annotations, tracks and detections."""

from .frames import SyntheticFrames, register
from .tables import label_csv, mot_truth, raw_label_etl, track_json, write_clips, write_tracks

__all__ = ["SyntheticFrames", "register", "label_csv", "mot_truth", "raw_label_etl", "track_json", "write_clips", "write_tracks"]
