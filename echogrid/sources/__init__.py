"""Sources and sinks: SEG-Y files, CSV tables beside them, directory and list inputs."""
