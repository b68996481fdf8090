"""Writers of JSON artefacts and the stored index."""
