"""voxlake: array queries over multiscale volumes, expressed as Spark plans."""
