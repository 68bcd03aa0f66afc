"""Sources: FASTQ, SAM, BAM, whitelists, lists of files."""
