"""What is read and written: seeds, manifests, bodies, reports, synthetic assets."""
