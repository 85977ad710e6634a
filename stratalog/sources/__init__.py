"""Where logs are kept: a store on a directory, and binary commit and value logs."""
