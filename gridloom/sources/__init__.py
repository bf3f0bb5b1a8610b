"""Readers and writers: tolerant text scans, archives, vector layers, tables, resumable sinks."""
