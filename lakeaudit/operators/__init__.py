"""DataFrame operators.

audit   -- manifest join, classification, next manifest, directory changes, counters
ignore  -- hierarchical ignore rules, depth limits, ignored-entry report
roots   -- nearest manifest root of each path
dups    -- duplicate bags, placement classes, space accounting, dedup plan and remap
fuse    -- many manifests into one
seal    -- combinable per-directory seals
rates   -- rate buckets and 8-level scales
joins   -- size-checked broadcast, salted joins for hot keys
"""
