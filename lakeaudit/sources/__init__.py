"""Sources: tables and rows as objects, file walks and digests, manifest files."""
